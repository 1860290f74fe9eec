"""Consensus wording of several annotators, their agreement and their reliability.

Every page's wordings are aligned with its commonest one, which turns them into labels on word
slots and on the gaps between them. A competence-and-spamming mixture explains the labels: each is
the slot's true word with the annotator's competence, or else drawn from the annotator's own guess
distribution over kinds of labels (nothing, a word near the slot's own, any other), evenly within a
kind. Expectation-maximisation yields competences, guess distributions
and, for every slot, the posterior over its candidate words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.llm.homoglyph import Form
from warraq.llm.wording import ABSTAIN, distance, words_of
from warraq.session import checkpoint, hot_keys, salted_join

#: Rounds of expectation-maximisation at most, and the change of any rate below which they end.
ROUNDS = 40
CONVERGED = 1e-4
START_COMPETENCE = 0.9
#: Kinds of labels (nothing, a word of one letter's difference, any other), and how many labels of a kind a guess may
#: fall on besides those seen at the slot.
KINDS = "enw"
UNSEEN = {"e": 0, "n": 10, "w": 20}
EVEN = (1 / 3, 1 / 3, 1 / 3)


def align(words: list[str], pivot: list[str]) -> list[tuple[int, str]]:
    """Edits that turn ``pivot`` into ``words``: (slot, value), for the slots where they differ.

    Slot 2i+1 is the pivot's i-th word ('' for a missing one), slot 2i the gap before it (its value
    is what was put in). An abstention is the value :data:`ABSTAIN`.
    """
    a, b = words, pivot
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(a) - start and end < len(b) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    n, m = len(a), len(b)
    if not n and not m:
        return []
    cost = [list(range(m + 1))]
    for i in range(1, n + 1):
        x, up = a[i - 1], cost[-1]
        row = [i]
        for j in range(1, m + 1):
            y = b[j - 1]
            sub = up[j - 1] + (0 if x == y else 0.5 if x == ABSTAIN else 1)
            row.append(min(sub, up[j] + 1, row[j - 1] + 1))
        cost.append(row)
    edits: list[tuple[int, str]] = []
    added: dict[int, list[str]] = {}
    i, j = n, m
    while i or j:
        if i and j:
            x, y = a[i - 1], b[j - 1]
            sub = 0 if x == y else 0.5 if x == ABSTAIN else 1
            if cost[i][j] == cost[i - 1][j - 1] + sub:
                if sub:
                    edits.append((2 * (start + j - 1) + 1, x))
                i, j = i - 1, j - 1
                continue
        if j and cost[i][j] == cost[i][j - 1] + 1:
            edits.append((2 * (start + j - 1) + 1, ""))
            j -= 1
        else:
            if a[i - 1] != ABSTAIN:
                added.setdefault(2 * (start + j), []).append(a[i - 1])
            i -= 1
    edits += [(slot, " ".join(reversed(w))) for slot, w in added.items()]
    return sorted(edits)


# --- the mixture -------------------------------------------------------------

# A pattern is what the mixture sees of a slot: for each candidate value, its kind and
# how many votes of which annotator it got. Slots with equal patterns have equal posteriors.
Pattern = tuple[tuple[str, tuple[tuple[str, float], ...]], ...]
Params = dict[str, tuple[float, tuple[float, ...]]]  # annotator -> competence, chances of a guess's kinds


_VALUE, _VOTE, _COUNT = "\x1d", "\x1e", "\x1f"  # separators of a pattern's text


def kind_of(value: str, own: str) -> str:
    """Nothing, near the slot's own word (one letter's difference), or any other word."""
    if not value:
        return "e"
    return "n" if own and value != own and abs(len(value) - len(own)) <= 1 and distance(value, own) == 1 else "w"


def pattern_text(values: list[tuple[str, dict[str, float]]]) -> str:
    return _VALUE.join(kind + _VOTE.join(f"{a}{_COUNT}{n:g}" for a, n in sorted(votes.items())) for kind, votes in values)


@lru_cache(maxsize=100_000)
def _parse(text: str) -> Pattern:
    out = []
    for part in text.split(_VALUE):
        votes = tuple((v.rpartition(_COUNT)[0], float(v.rpartition(_COUNT)[2])) for v in part[1:].split(_VOTE) if v)
        out.append((part[0], votes))
    return tuple(out)


def _guesses(pattern: Pattern) -> dict[str, int]:
    """How many labels of each kind a guess may fall on at the slot."""
    kinds = [kind for kind, _ in pattern]
    return {k: max(1, kinds.count(k) + UNSEEN[k]) for k in KINDS}


def posterior(pattern: Pattern, params: Params) -> list[float]:
    """Probability of each candidate value being the true one."""
    many = _guesses(pattern)
    logs = []  # of each value's odds against all labels being guesses: one pass over the votes
    for kind, votes in pattern:
        s = 0.0
        for a, n in votes:
            c, p = params.get(a, (START_COMPETENCE, EVEN))
            g = (1 - c) * p[KINDS.index(kind)] / many[kind]
            s += n * math.log((c + g) / g)
        logs.append(s)
    top = max(logs)
    q = [math.exp(x - top) for x in logs]
    z = sum(q)
    return [x / z for x in q]


def expected(pattern: Pattern, params: Params) -> list[tuple]:
    """Expected (annotator, truthful labels, guesses of each kind) of a slot."""
    q = posterior(pattern, params)
    many = _guesses(pattern)
    out = []
    for v, (kind, votes) in enumerate(pattern):
        for a, n in votes:
            c, p = params.get(a, (START_COMPETENCE, EVEN))
            true = q[v] * c / (c + (1 - c) * p[KINDS.index(kind)] / many[kind])
            out.append((a, n * true, *[n * (1 - true) if kind == k else 0.0 for k in KINDS]))
    return out


def fit(patterns: DataFrame, rounds: int = ROUNDS) -> Params:
    """Expectation-maximisation over (pattern, slots) until no rate changes; only sums per annotator reach the driver."""
    params: Params = {}
    for _ in range(rounds):
        now = dict(params)

        def step(batches: Iterator[pd.DataFrame], now: Params = now) -> Iterator[pd.DataFrame]:
            total: dict[str, np.ndarray] = {}
            for pdf in batches:
                for text, slots in zip(pdf["pattern"], pdf["slots"]):
                    for a, *sums in expected(_parse(text), now):
                        total.setdefault(a, np.zeros(1 + len(KINDS)))[:] += slots * np.array(sums)
            yield pd.DataFrame([(a, *s) for a, s in total.items()], columns=["annotator", "t", *KINDS])

        kinds = ", ".join(f"{k} double" for k in KINDS)
        sums = patterns.mapInPandas(step, f"annotator string, t double, {kinds}").groupBy("annotator").agg(*[F.sum(c).alias(c) for c in ("t", *KINDS)])
        last, params = params, {}
        for r in sums.collect():
            guesses = sum(r[k] for k in KINDS)
            chances = tuple((r[k] + 0.5) / (guesses + 0.5 * len(KINDS)) for k in KINDS)
            params[r["annotator"]] = (min(0.9999, (r["t"] + 0.9) / (r["t"] + guesses + 1.0)), chances)
        if last.keys() == params.keys() and all(abs(x - y) < CONVERGED for a in params for x, y in zip((params[a][0], *params[a][1]), (last[a][0], *last[a][1]))):
            break
    return params


# --- the operator ------------------------------------------------------------


class Consensus:
    """The annotators' rows of a corpus brought together.

    ``pooled`` names the pages on which every row is a voice of its own; elsewhere an annotator's
    rows share one voice. Null and empty texts have no wording and no voice. Pages are never held
    in one task: wordings are grouped before they are aligned, and hot pages are salted.
    """

    def __init__(self, df: DataFrame, key: str = "row_id", page: str = "page_id", annotator: str = "system", text: str = "text", prefix: str = "gt_", pooled: tuple[str, ...] = (), rounds: int = ROUNDS):
        self.key, self.page = key, page
        slim = df.select(F.col(key).alias("_key"), F.col(page).cast("string").alias("_page"), F.col(annotator).cast("string").alias("_who"), F.col(text).cast("string").alias("_text"))
        slim = slim.where(F.col("_who").startswith(prefix) & F.col("_page").isNotNull() & F.col("_text").isNotNull())
        self.rows = checkpoint(self._wordings(slim).withColumn("_wid", F.xxhash64("wording")))
        rows = self.rows
        hot = hot_keys(rows, "_page")
        votes = rows.groupBy("_page", "_who", "_wid").agg(F.count("*").cast("double").alias("n"))
        pooled_page = F.col("_page").isin(list(pooled))
        totals = votes.groupBy("_page", "_who").agg(F.sum("n").alias("all"))
        votes = votes.join(totals, ["_page", "_who"]).select("_page", "_wid", "_who", F.when(pooled_page, F.col("n")).otherwise(F.col("n") / F.col("all")).alias("n"))
        texts = rows.groupBy("_page", "_wid").agg(F.first("wording").alias("wording"))
        by_wording = votes.groupBy("_page", "_wid").agg(F.sum("n").alias("n"), F.collect_list(F.struct("_who", "n")).alias("who"))
        by_wording = by_wording.join(texts, ["_page", "_wid"])
        pivots = by_wording.groupBy("_page").agg(F.max_by("wording", F.struct("n", F.length("wording"), "_wid")).alias("pivot"), F.sum("n").alias("voices"))
        who = votes.groupBy("_page", "_who").agg(F.sum("n").alias("n")).groupBy("_page").agg(F.collect_list(F.struct("_who", "n")).alias("page_who"))
        self.pages = checkpoint(pivots.join(who, "_page").withColumn("annotators", F.size("page_who")))
        self.edits = checkpoint(self._edits(salted_join(by_wording, self.pages.select("_page", "pivot"), "_page", hot, "_wid", "inner")))
        slots = self.edits.select("_page", F.explode("edits").alias("e"), "who").select("_page", "e.slot", "e.value", F.explode("who").alias("w"))
        slots = slots.groupBy("_page", "slot", "value", "w._who").agg(F.sum("w.n").alias("n"))
        slots = slots.groupBy("_page", "slot").agg(F.collect_list(F.struct("value", "_who", "n")).alias("votes"))
        slots = slots.join(self.pages.select("_page", "page_who", F.split("pivot", " ").alias("words")), "_page")
        own = F.when(F.col("slot") % 2 == 1, F.try_element_at("words", ((F.col("slot") + 1) / 2).cast("int"))).otherwise("")
        self.slots = checkpoint(self._patterns(slots.select("_page", "slot", own.alias("own"), "votes", "page_who")))
        self.params = fit(checkpoint(self._pattern_counts()), rounds)

    @staticmethod
    def _wordings(slim: DataFrame) -> DataFrame:
        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            form = Form()
            for pdf in batches:
                pdf["wording"] = [" ".join(words_of(t, form)) for t in pdf.pop("_text")]
                yield pdf[pdf["wording"] != ""]

        kind = dict(slim.dtypes)["_key"]
        return slim.mapInPandas(scan, f"_key {kind}, _page string, _who string, wording string")

    @staticmethod
    def _edits(joined: DataFrame) -> DataFrame:
        @F.pandas_udf("array<struct<slot: int, value: string>>")
        def differ(wording: pd.Series, pivot: pd.Series) -> pd.Series:
            return pd.Series([[{"slot": s, "value": v} for s, v in align(a.split(), b.split())] for a, b in zip(wording, pivot)])

        changed = joined.where(F.col("wording") != F.col("pivot"))
        return changed.select("_page", "_wid", "who", differ("wording", "pivot").alias("edits"))

    @staticmethod
    def _patterns(slots: DataFrame) -> DataFrame:
        """(page, slot, own, values, pattern): candidate values with the pivot's own first."""

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for page, slot, own, votes, who in pdf.itertuples(index=False):
                    rest = {w["_who"]: w["n"] for w in who}
                    by: dict[str, dict[str, float]] = {}
                    for v in votes:
                        rest[v["_who"]] = rest.get(v["_who"], 0.0) - v["n"]
                        if v["value"] != ABSTAIN:
                            by.setdefault(v["value"], {})[v["_who"]] = v["n"]
                    mine = {a: n for a, n in rest.items() if n > 1e-9}
                    for a, n in by.pop(own, {}).items():
                        mine[a] = mine.get(a, 0.0) + n
                    values = sorted(by.items(), key=lambda kv: (-sum(kv[1].values()), kv[0]))
                    out.append((page, slot, own, [own] + [v for v, _ in values], pattern_text([(kind_of(own, own), mine)] + [(kind_of(v, own), d) for v, d in values])))
                yield pd.DataFrame(out, columns=["_page", "slot", "own", "values", "pattern"])

        return slots.mapInPandas(scan, "_page string, slot int, own string, values array<string>, pattern string")

    def _pattern_counts(self) -> DataFrame:
        disputed = self.slots.groupBy("pattern").agg(F.count("*").alias("slots"))
        left = self.slots.where("slot % 2 = 1").groupBy("_page").agg(F.count("*").alias("d"))
        votes = F.array_join(F.array_sort(F.transform("page_who", lambda w: F.concat(w["_who"], F.lit(_COUNT), w["n"].cast("string")))), _VOTE)
        words = F.size(F.split("pivot", " "))
        settled = self.pages.join(left, "_page", "left").select(F.concat(F.lit("w"), votes).alias("pattern"), (words - F.coalesce("d", F.lit(0))).cast("long").alias("slots"))
        return disputed.unionByName(settled).groupBy("pattern").agg(F.sum("slots").alias("slots")).where("slots > 0")

    def resolved(self) -> DataFrame:
        """Disputed slots: (_page, slot, own, value, confidence, agreement), value being the consensus."""
        params = self.params

        @F.pandas_udf("struct<at: int, confidence: double, agreement: double>")
        def settle(pattern: pd.Series) -> pd.DataFrame:
            @lru_cache(maxsize=100_000)
            def one(text: str) -> tuple[int, float, float]:
                p = _parse(text)
                q = posterior(p, params)
                best = max(range(len(q)), key=lambda i: (q[i], sum(n for _, n in p[i][1]), -i))
                counts = [sum(n for _, n in votes) for _, votes in p]
                total = sum(counts)
                agree = sum(c * (c - 1) for c in counts if c > 1) / (total * (total - 1)) if total > 1 else 1.0
                return best, q[best], agree

            return pd.DataFrame([one(t) for t in pattern], columns=["at", "confidence", "agreement"])

        s = self.slots.withColumn("s", settle("pattern"))
        return s.select("_page", "slot", "own", F.element_at("values", F.col("s.at") + 1).alias("value"), F.col("s.confidence").alias("confidence"), F.col("s.agreement").alias("agreement"))

    def departing(self, least_annotators: int = 3) -> DataFrame:
        """Rows whose wording departs from the consensus, on pages with enough annotators: (key)."""
        res = checkpoint(self.resolved().select("_page", "slot", "own", "value"))
        pages = self.pages.where(F.col("annotators") >= least_annotators)
        own = self.edits.select("_page", "_wid", F.explode("edits").alias("e")).select("_page", "_wid", "e.slot", F.col("e.value").alias("has"))
        wrong = own.join(res, ["_page", "slot"]).where((F.col("has") != F.col("value")) & (F.col("has") != ABSTAIN)).select("_page", "_wid")
        over = res.where(~F.col("value").eqNullSafe(F.col("own"))).groupBy("_page").agg(F.collect_list("slot").alias("over"))
        wordings = self.rows.select("_page", "_wid").distinct().join(over, "_page").join(self.edits.select("_page", "_wid", "edits"), ["_page", "_wid"], "left")
        touched = F.transform(F.coalesce("edits", F.array().cast("array<struct<slot: int, value: string>>")), lambda e: e["slot"])
        stays = wordings.where(F.exists("over", lambda s: ~F.array_contains(touched, s))).select("_page", "_wid")
        bad = wrong.unionByName(stays).distinct().join(pages.select("_page"), "_page", "left_semi")
        bad = self._differs(bad)
        return self.rows.select("_key", "_page", "_wid").join(bad, ["_page", "_wid"], "left_semi").select(F.col("_key").alias(self.key))

    def _differs(self, wordings: DataFrame) -> DataFrame:
        """Exact check: the wordings that an alignment with the consensus itself shows to differ.

        By way of the pivot, repeated words can be given to different slots though the wordings are equal.
        """

        @F.pandas_udf("boolean")
        def differs(wording: pd.Series, consensus: pd.Series) -> pd.Series:
            return pd.Series([a != b and any(v != ABSTAIN for _, v in align(a.split(), b.split())) for a, b in zip(wording, consensus)], dtype=bool)

        texts = self.rows.join(wordings, ["_page", "_wid"], "left_semi").groupBy("_page", "_wid").agg(F.first("wording").alias("wording"))
        agreed = self.consensus().select(F.col(self.page).alias("_page"), "consensus")
        return salted_join(texts, agreed, "_page", hot_keys(texts, "_page"), "_wid", "inner").where(differs("wording", "consensus")).select("_page", "_wid")

    def consensus(self) -> DataFrame:
        """(page, consensus, annotators, voices, agreement, confidence) for every page with a wording.

        ``agreement`` is the share of agreeing pairs of voices, averaged over the page's word slots
        and disputed gaps; 1 for a lone voice.
        """
        res = self.resolved()
        per = res.groupBy("_page").agg(
            F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("fix"), F.sum("agreement").alias("a"), F.sum("confidence").alias("c"), F.count("*").alias("d"), F.sum((F.col("slot") % 2 == 0).cast("int")).alias("gaps")
        )
        words = F.split("pivot", " ")
        p = self.pages.join(per, "_page", "left").withColumn("fix", F.coalesce("fix", F.create_map().cast("map<int,string>")))
        pick = lambda slot, default: F.coalesce(F.try_element_at("fix", slot.cast("int")), default)
        text = F.concat_ws(
            " ",
            F.filter(
                F.concat(
                    F.flatten(F.transform(words, lambda w, i: F.array(pick(2 * i, F.lit("")), pick(2 * i + 1, w)))), F.array(pick(2 * F.size(words), F.lit("")))
                ),
                lambda w: w != "",
            ),
        )
        slots = F.size(words) + F.coalesce("gaps", F.lit(0))
        rest = slots - F.coalesce("d", F.lit(0))
        return p.select(
            F.col("_page").alias(self.page), text.alias("consensus"), "annotators", "voices",
            ((rest + F.coalesce("a", F.lit(0.0))) / slots).alias("agreement"), ((rest + F.coalesce("c", F.lit(0.0))) / slots).alias("confidence"),
        )

    def reliability(self) -> DataFrame:
        """(annotator, competence, guesses_nothing, guesses_near, guesses_other) as estimated by the mixture."""
        spark = self.rows.sparkSession
        rows = [(a, c, *p) for a, (c, p) in sorted(self.params.items())]
        return spark.createDataFrame(rows, "annotator string, competence double, guesses_nothing double, guesses_near double, guesses_other double")
