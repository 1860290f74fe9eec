"""Texts cut off by field limits or in mid-transfer.

Lengths are recomputed under alternative encodings, escapings and newline conventions and grouped
by each over all rows of a source: a length that far more pages share than its neighbours exposes a
hidden storage limit. How much of such a pile-up is beyond chance is the belief that a row there was
cut; its ending, compared with the end that the page's other transcriptions agree on, then confirms
or refutes it. Away from limits the ending has to carry more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.llm.homoglyph import Form
from warraq.llm.wording import body_words, likeness_cost
from warraq.session import checkpoint, hot_keys, salted_join

TAIL = 8
#: Lengths on either side that tell how many pages a length has by chance.
NEAR = 12
#: Chance that any length of the whole table passes for a limit by accident.
FALSE_LIMITS = 0.01
#: Peaks that are broadcast at most; more are joined.
MOST_PEAKS = 50_000
#: Belief that a row away from all limits was cut, before its ending is looked at.
BASE = 0.02
# Log-odds that an ending speaks for a cut. The page's own end; another word in its place; words missing
# or one begun; an end found nowhere. A stop or a sign of cutting at the end; where the page has nothing to compare with.
SAME, OTHER, MISSING, NOWHERE = -9.0, 0.0, 6.0, 8.0
STOP, NO_STOP, SIGN, LONE_SIGN = -3.0, 1.0, 2.0, 5.0
_CUT_SIGN = re.compile(r"(?:…|\.{2,}|\[(?:\.+|…)\]|�|\\|&\w{0,6}|\\u[0-9a-fA-F]{0,4})\s*$")
_STOP = re.compile(r"[.؟?!:؛=)\]]\s*$")


_FIVE = re.compile("[\x80-\u03e7\u2710-\U0010ffff]")  # codes beyond ASCII that don't have four digits
_CONTROL = re.compile("[\x00-\x07\x0b\x0e-\x1f]")


def lengths(text: str) -> tuple[int, ...]:
    """The lengths of a text as it would be stored, in the order of ``LENGTHS``.

    Characters, bytes, UTF-16 units, with HTML escapes, with numeric entities, with JSON escapes (all ASCII or not), with CR LF.
    """
    n, utf8, count = len(text), len(text.encode("utf-8", "surrogatepass")), text.count
    breaks = count("\n")
    wide = n - len(text.encode("ascii", "ignore"))
    odd = _FIVE.findall(text) if wide else ()
    beyond = sum(c > "\uffff" for c in odd)
    short = count('"') + count("\\") + breaks + count("\t") + count("\r") + count("\b") + count("\f")
    control = len(_CONTROL.findall(text))
    return (
        n,
        utf8,
        n + beyond,
        n + 4 * count("&") + 3 * (count("<") + count(">")) + 5 * (count('"') + count("'")),
        n + 6 * wide + sum(len(str(ord(c))) - 4 for c in odd),
        n + short + 5 * (control + count("\x7f") + wide) + 6 * beyond,
        utf8 + short + 5 * control,
        n + breaks,
        utf8 + breaks,
    )


LENGTHS = ("chars", "utf8", "utf16", "html", "entities", "json", "json_utf8", "crlf", "utf8_crlf")


def missing_end(row: list[str], page: list[str]) -> tuple[float, int, bool]:
    """Align the last words of a row with those of its page.

    Returns the cost a word of the alignment, how many of the page's last words have no partner,
    and whether the last pair is a word and a proper prefix of it.
    """
    n, m = len(row), len(page)
    cost = [[0.0] * (m + 1) for _ in range(n + 1)]
    step = [[""] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            a, b = row[i - 1], page[j - 1]
            sub = 0.1 if len(a) < len(b) and b.startswith(a) and i == n else likeness_cost(a, b)
            options = ((cost[i - 1][j - 1] + sub, "s"), (cost[i][j - 1] + 0.75, "d"), (cost[i - 1][j] + 0.75, "i"))
            cost[i][j], step[i][j] = min(options)
    i, j, lost = n, m, 0
    while i and j and step[i][j] == "d":
        lost, j = lost + 1, j - 1
    part = bool(i and j and step[i][j] == "s" and i == n and row[-1] != page[j - 1] and page[j - 1].startswith(row[-1]))
    return cost[n][m] / max(1, min(n, m)), lost, part


def verdict(tail: str, page: str) -> float:
    """How surely the tail stops before the page's end: 0 for not at all, 1 for surely."""
    row, ref = tail.split(), page.split()
    if not ref or tail == page:
        return 0.0
    if not row or row[-2:] == ref[-2:]:
        return 0.0
    cost, lost, part = missing_end(row, ref)
    if cost > 0.5:
        return 1.0
    if lost or part:
        return 0.9
    return 0.0


def last_words(text: str, form: Form) -> list[str]:
    """The last words of the running text, read from as many lines at its end as it takes."""
    lines, k = text.split("\n"), 4
    while True:
        words = body_words("\n".join(lines[-k:]), form)
        if len(words) >= TAIL or k >= len(lines):
            return words[-TAIL:]
        k *= 2


def _features(df: DataFrame, key: str, page: str, source: str, text: str) -> DataFrame:
    slim = df.select(
        F.col(key).alias("_key"), F.col(page).cast("string").alias("_page"), F.col(source).cast("string").alias("_source"), F.col(text).cast("string").alias("_text")
    ).where(F.col("_text").isNotNull() & (F.col("_text") != ""))

    @F.pandas_udf("tail string, words int, sign boolean, stop boolean, " + ", ".join(f"{k} int" for k in LENGTHS))
    def ending(texts: pd.Series) -> pd.DataFrame:
        form = Form()
        out = []
        for t in texts:
            end = t.rstrip()[-40:]  # longer than any sign
            sign = _CUT_SIGN.search(end) is not None
            out.append((" ".join(last_words(_CUT_SIGN.sub("", t) if sign else t, form)), len(t.split()), sign, _STOP.search(end) is not None, *lengths(t)))
        return pd.DataFrame(out, columns=["tail", "words", "sign", "stop", *LENGTHS])

    parts = ("tail", "words", "sign", "stop")
    return slim.withColumn("_e", ending("_text")).select("_key", "_page", "_source", *[f"_e.{c}" for c in parts], F.struct(*[F.col(f"_e.{k}") for k in LENGTHS]).alias("lengths"))


def _page_ends(rows: DataFrame) -> DataFrame:
    """The last words of each page that most transcriptions agree on, longer ones first at a tie."""
    weight = F.when(F.col("_source").startswith("gt_"), 2).otherwise(1)
    a = rows.where("tail != ''").groupBy("_page", "tail").agg(F.sum(weight).alias("votes"), F.max("words").alias("words"))
    a = a.withColumn("end", F.array_join(F.slice(F.reverse(F.split("tail", " ")), 1, 3), " "))
    b = a.groupBy("_page", "end").agg(F.sum("votes").alias("votes"), F.max("words").alias("words"), F.max_by("tail", F.struct("votes", "words", "tail")).alias("tail"))
    return b.groupBy("_page").agg(F.max_by("tail", F.struct("votes", "words", "tail")).alias("page_tail"), F.sum("votes").alias("page_votes"))


def endings(df: DataFrame, key: str = "row_id", page: str = "page_id", source: str = "system", text: str = "text") -> DataFrame:
    """One row per non-empty text: its lengths, and how surely it stops before the page's end."""
    rows = checkpoint(_features(df, key, page, source, text))
    ends = _page_ends(rows.where("_page is not null"))
    paged = rows.where("_page is not null")
    joined = salted_join(paged, ends, "_page", hot_keys(paged, "_page"), "_key")

    @F.pandas_udf("double")
    def judge(tail: pd.Series, ref: pd.Series) -> pd.Series:
        return pd.Series([verdict(a, b) if b else 0.0 for a, b in zip(tail, ref)], dtype=float)

    none = rows.where("_page is null").withColumns({"page_tail": F.lit(None).cast("string"), "page_votes": F.lit(None).cast("long")}).select(*joined.columns)
    differs = ~F.col("tail").eqNullSafe(F.col("page_tail"))
    judged = joined.where(differs).withColumn("doubt", judge("tail", "page_tail"))
    same = joined.where(~differs).withColumn("doubt", F.lit(0.0))
    return checkpoint(judged.unionByName(same).unionByName(none.withColumn("doubt", F.lit(0.0))))


def limits(ends: DataFrame, near: int = NEAR, chance: float = FALSE_LIMITS) -> DataFrame:
    """Hidden storage limits: (source, measure, length, pages, expected, excess), found from all rows.

    Pages of a source are counted at each length under each measure, so that a page delivered over and over counts
    once. A length is a limit if so many pages are there that, by the Poisson bound and against the mean of its
    ``near`` neighbours on either side, no length of the whole table would have them by chance; the bound grows with
    the number of lengths tried. ``excess`` is the share of the pages beyond the expected ones.
    """
    once = ends.select("_source", "_page", "lengths").distinct()
    each = once.select(F.col("_source").alias("source"), F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(f"lengths.{k}").alias("length")) for k in LENGTHS])).alias("m"))
    per = checkpoint(each.groupBy("source", "m.measure", "m.length").agg(F.count("*").alias("pages")))
    tried = max(1, per.count())
    around = per.where("pages > 0").select("source", "measure", F.explode(F.sequence(F.col("length") - near, F.col("length") + near)).alias("length"), "pages").groupBy("source", "measure", "length").agg(F.sum("pages").alias("around"))
    n, expected = F.col("pages"), F.greatest((F.col("around") - F.col("pages")) / (2 * near), F.lit(0.5))
    bound = n * F.log(n / expected) - n + expected
    peaks = per.where("pages > 1").join(around, ["source", "measure", "length"])
    return peaks.withColumn("expected", expected).where((n > F.col("expected")) & (bound > F.log(F.lit(float(tried))) - F.log(F.lit(chance)))).select("source", "measure", "length", "pages", "expected", (1 - F.col("expected") / n).alias("excess"))


def _with_excess(ends: DataFrame) -> DataFrame:
    """The rows with ``excess``: the largest excess of a limit that their length meets, else 0."""
    peaks = checkpoint(limits(ends))
    if peaks.count() <= MOST_PEAKS:
        entry = F.struct(F.concat_ws(":", "measure", "length"), "excess")
        of_source = F.broadcast(peaks.groupBy(F.col("source").alias("_source")).agg(F.map_from_entries(F.collect_list(entry)).alias("_peaks")))
        at = [F.coalesce(F.try_element_at("_peaks", F.concat_ws(":", F.lit(k), F.col(f"lengths.{k}"))), F.lit(0.0)) for k in LENGTHS]
        return ends.join(of_source, "_source", "left").withColumn("excess", F.greatest(*at)).drop("_peaks")
    each = ends.select("_key", F.col("_source").alias("source"), F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(f"lengths.{k}").alias("length")) for k in LENGTHS])).alias("m")).select("_key", "source", "m.*")
    best = each.join(peaks, ["source", "measure", "length"]).groupBy("_key").agg(F.max("excess").alias("excess"))
    return ends.join(best, "_key", "left").withColumn("excess", F.coalesce("excess", F.lit(0.0)))


def truncated(df: DataFrame, key: str = "row_id", page: str = "page_id", source: str = "system", text: str = "text") -> DataFrame:
    """Rows whose text stops before the end of its page: (key, source, reason).

    Log-odds are added up: of the belief that its length gives (the excess at a limit, else a small base rate) and of
    its ending (the page's own end, another word, words missing; a stop, none, a sign of cutting). A row is cut if they
    come out positive; the reason is ``field limit`` where its length is one, else ``mid-transfer``. Null and empty texts
    are no cases, rows without a page have nothing to compare with; copies of a row are judged alike; extra columns
    play no part.
    """
    rows = _with_excess(endings(df, key, page, source, text))
    lone = F.coalesce(F.col("page_votes") <= F.when(F.coalesce(F.col("_source").startswith("gt_"), F.lit(False)), 2).otherwise(1), F.lit(True))
    belief = F.greatest(F.least(F.col("excess"), F.lit(0.95)), F.lit(BASE))
    last = lambda t: F.element_at(F.split(t, " "), -1)
    at_end = F.when(F.col("stop") & ~F.col("sign"), STOP).when(F.col("sign"), SIGN).otherwise(NO_STOP)
    compared = (
        F.when(F.col("doubt") >= 1, NOWHERE).when(F.col("doubt") > 0, MISSING)
        .when(last(F.col("tail")) == last(F.col("page_tail")), SAME).otherwise(OTHER + at_end)
    )
    alone = F.when(F.col("sign"), LONE_SIGN).otherwise(at_end)
    odds = F.log(belief / (1 - belief)) + F.when(F.col("doubt") > 0, compared).when(lone, alone).otherwise(compared)
    reason = F.when(F.col("excess") > 0, "field limit").otherwise("mid-transfer")
    return rows.where(odds > 0).select(F.col("_key").alias(key), F.col("_source").alias(source), reason.alias("reason"))


def rates(df: DataFrame, key: str = "row_id", page: str = "page_id", source: str = "system", text: str = "text") -> DataFrame:
    """How often each source truncates: (source, rows, cut, rate); sources without a cut row show 0."""
    cut = truncated(df, key, page, source, text).groupBy(source).agg(F.count("*").alias("cut"))
    rows = df.groupBy(F.col(source).cast("string").alias(source)).agg(F.count("*").alias("rows"))
    out = rows.join(cut, source, "left").na.fill(0, ["cut"])
    return out.withColumn("rate", F.col("cut") / F.col("rows"))
