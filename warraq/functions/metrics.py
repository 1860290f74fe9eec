"""Error rates and overlap scores of a reference and a hypothesis as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warraq.functions.align import far_distance, word_distance
from warraq.functions.normalize import char_tokens, word_tokens

#: Width of the band that the JVM tries first; beyond it bit-parallel distances are cheaper than its full table.
BAND = 16


@dataclass(frozen=True)
class Rate:
    """A score to compute: its name, its kind, and the columns of reference and hypothesis.

    Kinds: ``cer`` (code points, spaces dropped), ``wer`` (words), ``der`` and ``der_bounded``
    (diacritic strings), ``distance`` (code points, spaces kept).
    """

    name: str
    kind: str
    ref: str
    hyp: str


def score(df: DataFrame, rates: list[Rate]) -> DataFrame:
    """Adds the rates to ``df``, step by step, so that nothing is computed twice.

    Each step is a projection of its own: tokens, the distance within a band, and bit-parallel
    distances for pairs beyond it. Words are compared as words, however many distinct ones there are.
    """
    keep = df.columns
    chars = {c: f"_c_{c}" for r in rates if r.kind == "cer" for c in (r.ref, r.hyp)}
    df = df.select("*", *[char_tokens(F.col(c)).alias(a) for c, a in chars.items()])
    pair = {i: (chars[r.ref], chars[r.hyp]) if r.kind == "cer" else (r.ref, r.hyp) for i, r in enumerate(rates)}
    by_char = {ab: f"_d_{k}" for k, ab in enumerate(dict.fromkeys(pair[i] for i, r in enumerate(rates) if r.kind != "wer"))}
    by_word = {ab: f"_w_{k}" for k, ab in enumerate(dict.fromkeys(pair[i] for i, r in enumerate(rates) if r.kind == "wer"))}
    if by_char:
        near = [F.when(F.col(a) == F.col(b), 0).when(F.abs(F.length(a) - F.length(b)) <= BAND, F.levenshtein(a, b, BAND)).otherwise(-1).alias(f"{n}_n") for (a, b), n in by_char.items()]
        df = df.select("*", *near)
    open_ = lambda n, c: F.when(F.col(f"{n}_n") < 0, F.col(c))
    differ = lambda a, b, c: F.when(F.col(a) != F.col(b), F.col(c))
    far = [far_distance(open_(n, a), open_(n, b)).alias(f"{n}_f") for (a, b), n in by_char.items()]
    far += [word_distance(differ(a, b, a), differ(a, b, b)).alias(f"{n}_f") for (a, b), n in by_word.items()]
    df = df.select("*", *far)
    settled = [F.when(F.col(f"{n}_n") >= 0, F.col(f"{n}_n")).otherwise(F.col(f"{n}_f")).alias(n) for n in by_char.values()]
    settled += [F.when(F.col(a) == F.col(b), 0).otherwise(F.col(f"{n}_f")).alias(n) for (a, b), n in by_word.items()]
    df = df.select("*", *settled)
    return df.select(*keep, *[_rate(r, F.col((by_word if r.kind == "wer" else by_char)[pair[i]]), *pair[i]).alias(r.name) for i, r in enumerate(rates)])


def _rate(r: Rate, d: Column, a: str, b: str) -> Column:
    if r.kind == "distance":
        return d
    if r.kind == "der":
        return F.when(F.length(a) > 0, d / F.length(a))
    if r.kind == "der_bounded":
        longest = F.greatest(F.length(a), F.length(b))
        return F.when(longest.isNotNull(), F.when(longest > 0, d / longest).otherwise(0.0))
    n = F.size(word_tokens(F.col(a))) if r.kind == "wer" else F.length(a)
    return d / F.greatest(n, F.lit(1))


def char_ngrams(text: Column, n: int) -> Column:
    """All substrings of ``n`` code points, in order; empty for shorter texts."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def with_jaccard(df: DataFrame, name: str, a: str, b: str, n: int = 5) -> DataFrame:
    """Adds the shared share of distinct character n-grams, spaces dropped; 0 if either text is shorter than n."""
    keep = df.columns
    df = df.select("*", char_tokens(F.col(a)).alias("_ta"), char_tokens(F.col(b)).alias("_tb"))
    df = df.select(*keep, F.array_distinct(char_ngrams(F.col("_ta"), n)).alias("_ga"), F.array_distinct(char_ngrams(F.col("_tb"), n)).alias("_gb"))
    df = df.select(*keep, F.size("_ga").alias("_na"), F.size("_gb").alias("_nb"), F.size(F.array_intersect("_ga", "_gb")).alias("_both"))
    share = F.col("_both") / (F.col("_na") + F.col("_nb") - F.col("_both"))
    return df.select(*keep, F.when((F.col("_na") > 0) & (F.col("_nb") > 0), share).otherwise(0.0).alias(name))


_STEP = np.uint64(0x100000001B3)


def _gram_keys(units: np.ndarray, orders: int) -> list[np.ndarray]:
    """For each order a 64-bit key of every n-gram, in order of place."""
    keys = [units.astype(np.uint64) + np.uint64(1)]
    for n in range(1, orders):
        keys.append(keys[-1][:-1] * _STEP + keys[0][n:] if len(keys[-1]) > 1 else keys[0][:0])
    return keys


def _clipped(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two multisets of keys."""
    if not len(x) or not len(y):
        return 0
    both = np.concatenate([x << np.uint64(1), y << np.uint64(1) | np.uint64(1)])
    both.sort()
    side = (both & np.uint64(1)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(both >> np.uint64(1)) != 0]))
    ones = np.add.reduceat(side, starts)
    return int(np.minimum(ones, np.diff(np.append(starts, len(both))) - ones).sum())


def _char_units(text: str) -> np.ndarray:
    return np.frombuffer("".join(text.split()).encode("utf-32-le", "surrogatepass"), np.uint32)


def _word_units(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    number: dict[str, int] = {}
    ids = [number.setdefault(w, len(number)) for w in (*a, *b)]
    return np.array(ids[: len(a)], np.uint64), np.array(ids[len(a) :], np.uint64)


def chrf_score(ref: str, hyp: str, orders: int = 6, beta: float = 2.0) -> float:
    """Character n-gram F-score without white space, averaged over the orders both sides have."""
    p = r = 0.0
    used = 0
    for x, y in zip(_gram_keys(_char_units(ref), orders), _gram_keys(_char_units(hyp), orders)):
        if len(x) and len(y):
            m = _clipped(x, y)
            p, r, used = p + m / len(y), r + m / len(x), used + 1
    if not used:
        return 0.0
    p, r = p / used, r / used
    return (1 + beta**2) * p * r / (beta**2 * p + r) if p + r > 0 else 0.0


def bleu_score(ref: str, hyp: str, orders: int = 4) -> float:
    """Sentence BLEU over white-space words: effective order, exponential smoothing, brevity penalty."""
    a, b = ref.split(), hyp.split()
    if not a or not b:
        return 0.0
    logs, used, smooth, any_match = 0.0, 0, 1.0, False
    u, v = _word_units(a, b)
    for x, y in zip(_gram_keys(u, orders), _gram_keys(v, orders)):
        total = len(y)
        if not total:
            break
        m = _clipped(x, y)
        used += 1
        if m:
            any_match = True
            logs += math.log(m / total)
        else:
            smooth *= 2
            logs += math.log(1 / (smooth * total))
    if not any_match:
        return 0.0
    brevity = 1.0 if len(b) >= len(a) else math.exp(1 - len(a) / len(b))
    return brevity * math.exp(logs / used)


@F.pandas_udf(T.StructType([T.StructField("chrf", T.DoubleType()), T.StructField("bleu", T.DoubleType())]))
def chrf_bleu(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Both n-gram scores of normalised texts; multisets of n-grams are cheaper here than as exploded rows."""
    return pd.DataFrame([(chrf_score(a, b), bleu_score(a, b)) for a, b in zip(ref, hyp)], columns=["chrf", "bleu"])
