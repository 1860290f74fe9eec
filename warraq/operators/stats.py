"""Means with bootstrap intervals, paired rank tests, step-down correction, box statistics."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from warraq.schema import SEED
from warraq.session import checkpoint

RESAMPLES = 1000
#: Chances that a unit is drawn at most 0, 1, 2, ... times, in units of 2**-32.
POISSON = [round(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12)]


def poisson_weights(units: np.ndarray, resamples: int = RESAMPLES, seed: int = SEED) -> np.ndarray:
    """How often each unit is drawn in each resample (units x resamples), from integer hashes alone.

    Weights depend on unit and resample only, so that all groups and metrics share their draws, any
    engine can repeat them, and partial sums combine whatever the partitioning.
    """
    m = np.uint64(0xFFFFFFFF)
    r = (np.arange(resamples, dtype=np.uint64) * np.uint64(2654435761)) & m
    u = (units.astype(np.uint64) * np.uint64(2246822519)) & m
    h = (u[:, None] + r[None, :] + np.uint64(seed)) & m
    h ^= h >> np.uint64(15)
    h = (h * np.uint64(739982445)) & m
    h ^= h >> np.uint64(12)
    h = (h * np.uint64(695872825)) & m
    h ^= h >> np.uint64(15)
    return np.searchsorted(np.array(POISSON, dtype=np.uint64), h, side="right").astype(np.float64)


def summarize(rows: DataFrame, keys: list[str], values: list[str], unit: Column, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """Long table (keys, metric, n_pages, n_values, mean, ci_lo, ci_hi) of percentile-bootstrap means.

    ``unit`` is a whole number that names what is resampled (the page). Nulls are left out of a
    metric's mean; n_pages counts all rows. Each task adds up its rows' weights and values per
    group and resample (number -1 counts every row once, for the mean); only those sums are shuffled,
    so ``rows`` are read once and groups may be of any size.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    slim = rows.select(*[F.col(k).alias(a) for k, a in zip(keys, ks)], unit.cast("long").alias("_unit"), *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    kinds = dict(slim.dtypes)
    n = len(values)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                w = poisson_weights(part["_unit"].fillna(-1).to_numpy().astype(np.int64), resamples, seed)
                w = np.concatenate([np.ones((len(part), 1)), w], axis=1)
                x = part[[f"_v{i}" for i in range(n)]].to_numpy(float)
                ok = ~np.isnan(x)
                x = np.where(ok, x, 0.0)
                names = list(map(tuple, part[ks].itertuples(index=False))) if ks else [()] * len(part)
                index: dict[tuple, list[int]] = {}
                for i, k in enumerate(names):
                    index.setdefault(k, []).append(i)
                for k, i in index.items():
                    t = total.setdefault(k, np.zeros((2 * n + 1, resamples + 1)))
                    t[:n] += x[i].T @ w[i]
                    t[n:-1] += ok[i].T.astype(float) @ w[i]
                    t[-1, 0] += len(i)
        out = [(*k, r - 1, t[:n, r].tolist(), t[n:-1, r].tolist(), int(t[-1, r])) for k, t in total.items() for r in range(resamples + 1)]
        yield pd.DataFrame(out, columns=[*ks, "_r", "_s", "_w", "_n"])

    schema = ", ".join([f"{a} {kinds[a]}" for a in ks] + ["_r int", "_s array<double>", "_w array<double>", "_n long"])
    sums = slim.mapInPandas(scan, schema).groupBy(*ks, "_r").agg(F.sum("_n").alias("_n"), *[F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in ("_s", "_w") for i in range(n)])
    drawn, whole = F.col("_r") >= 0, lambda c: F.max(F.when(F.col("_r") < 0, c))
    per = [F.try_divide(F.col(f"_s{i}"), F.col(f"_w{i}")) for i in range(n)]
    aggs = [x for i in range(n) for x in (whole(per[i]).alias(f"_m{i}"), whole(F.col(f"_w{i}").cast("long")).alias(f"_n{i}"), F.percentile(F.when(drawn, per[i]), F.array(F.lit(0.025), F.lit(0.975))).alias(f"_c{i}"))]
    both = sums.groupBy(*ks).agg(whole(F.col("_n")).alias("n_pages"), *aggs)
    if not ks:
        both = both.where("n_pages is not null")
    one = [F.struct(F.lit(v).alias("metric"), F.col(f"_n{i}").alias("n_values"), F.col(f"_m{i}").alias("mean"), F.col(f"_c{i}")[0].alias("ci_lo"), F.col(f"_c{i}")[1].alias("ci_hi")) for i, v in enumerate(values)]
    return both.select(*[F.col(a).alias(k) for a, k in zip(ks, keys)], "n_pages", F.explode(F.array(*one)).alias("s")).select(*keys, "n_pages", "s.*")


def widen(long: DataFrame, keys: list[str], metrics: Iterable[str]) -> DataFrame:
    """One row per group with <metric>_mean, <metric>_ci_lo and <metric>_ci_hi."""
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}")
    aggs = [pick(m, c) for m in metrics for c in ("mean", "ci_lo", "ci_hi")]
    return long.groupBy(*keys).agg(F.max("n_pages").alias("n_pages"), *aggs)


def bootstrap_numpy(values: Iterable[float | None], resamples: int = RESAMPLES, alpha: float = 0.05, seed: int = SEED) -> tuple[float | None, float | None, float | None]:
    """Mean and percentile interval with numpy's own generator, re-seeded at every call.

    Repeats the reference's draws; for groups that fit one machine, their values in its row order.
    """
    x = np.array([v for v in values if v is not None and v == v], dtype=float)
    if not len(x):
        return None, None, None
    rng, drawn = np.random.default_rng(seed), np.empty(0)
    for left in range(resamples, 0, -(step := max(1, 4_000_000 // len(x)))):  # as many resamples at a time as memory is small
        drawn = np.append(drawn, rng.choice(x, size=(min(step, left), len(x)), replace=True).mean(axis=1))
    lo, hi = np.quantile(drawn, [alpha / 2, 1 - alpha / 2])
    return float(x.mean()), float(lo), float(hi)


def summarize_numpy(rows: DataFrame, keys: list[str], value: str, order: str, most: int = 1_000_000) -> DataFrame:
    """(keys, n_values, mean, ci_lo, ci_hi) with :func:`bootstrap_numpy` for each group, its values in ``order``.

    A group's values are drawn on one machine: groups of more than ``most`` values are refused (:func:`summarize` takes them).
    """
    slim = rows.where(F.col(value).isNotNull()).select(*keys, F.col(order).alias("_order"), F.col(value).cast("double").alias("_v"))
    largest = slim.groupBy(*keys).count().agg(F.max("count").alias("n")).first()["n"] or 0
    if largest > most:
        raise ValueError(f"a group has {largest} values, more than {most}")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("_order", kind="stable")["_v"].to_numpy()
        return pd.DataFrame({**{k: pdf[k].iloc[:1] for k in keys}, "n_values": [len(x)], **{c: [v] for c, v in zip(("mean", "ci_lo", "ci_hi"), bootstrap_numpy(x))}})

    kinds = dict(slim.dtypes)
    return slim.groupBy(*keys).applyInPandas(one, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "n_values long, mean double, ci_lo double, ci_hi double"]))


# --- paired tests -------------------------------------------------------------


def system_pairs(rows: DataFrame, value: str, systems: list[str]) -> DataFrame:
    """(system_a, system_b, page_id, d) for all pairs of the list in its order, complete pages only."""
    wide = rows.groupBy("page_id").agg(*[F.max(F.when(F.col("system") == s, F.col(value))).alias(f"s{i}") for i, s in enumerate(systems)])
    combos = [(i, j) for i in range(len(systems)) for j in range(i + 1, len(systems))]
    each = [F.struct(F.lit(systems[i]).alias("system_a"), F.lit(systems[j]).alias("system_b"), F.lit(k).alias("ord"), (F.col(f"s{i}") - F.col(f"s{j}")).alias("d")) for k, (i, j) in enumerate(combos)]
    return wide.select("page_id", F.explode(F.array(*each)).alias("p")).select("page_id", "p.*").where("d is not null")


def wilcoxon(diffs: DataFrame, keys: list[str], least: int = 5, buckets: int = 2048) -> DataFrame:
    """Signed-rank statistic of the differences ``d`` of each group, zeros split between both sides.

    Equal sizes are counted first. Mean ranks then come from running counts within buckets of the
    size of a difference and over the buckets of a group, so no task sees a whole group.
    Differences are compared after rounding to 12 places, so that equal ones tie.
    """
    x = diffs.select(*keys, F.round("d", 12).alias("d"))
    size = F.abs("d")
    counts = x.groupBy(*keys, size.alias("s")).agg(F.count("*").alias("t"), F.sum((F.col("d") > 0).cast("long")).alias("up"), F.sum((F.col("d") < 0).cast("long")).alias("down"), F.sum("d").alias("sum_d"))
    counts = checkpoint(counts.withColumn("_b", F.least(F.floor(F.col("s") * buckets), F.lit(4 * buckets))))
    per = counts.groupBy(*keys, "_b").agg(F.sum("t").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_in", F.coalesce(F.sum("t").over(inside), F.lit(0))).join(per, [*keys, "_b"])
    rank = F.col("_base") + F.col("_in") + (F.col("t") + 1) / 2
    half = F.when(F.col("s") == 0, rank * F.col("t") / 2).otherwise(0.0)
    out = ranked.groupBy(*keys).agg(
        F.sum("t").alias("n_pairs"), (F.sum("sum_d") / F.sum("t")).alias("mean_diff"), F.sum(rank * F.col("up") + half).alias("r_plus"), F.sum(rank * F.col("down") + half).alias("r_minus"),
        F.sum(F.when(F.col("t") > 1, F.col("t") * F.col("t") * F.col("t") - F.col("t")).otherwise(0).cast("double")).alias("ties"), F.max(F.when(F.col("s") == 0, F.col("t")).otherwise(0)).alias("zeros"), F.max("t").alias("most_tied"),
    )
    out = out.where(F.col("n_pairs") >= least).withColumn("wilcoxon_stat", F.least("r_plus", "r_minus"))

    @F.pandas_udf("double")
    def p_value(n: pd.Series, stat: pd.Series, ties: pd.Series, exact: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_p(int(a), float(b), float(c), bool(e)) for a, b, c, e in zip(n, stat, ties, exact)])

    return out.withColumn("p_value", p_value("n_pairs", "wilcoxon_stat", "ties", (F.col("zeros") == 0) & (F.col("most_tied") == 1))).select(*keys, "n_pairs", "mean_diff", "wilcoxon_stat", "p_value")


def signed_rank_p(n: int, stat: float, ties: float, exact: bool) -> float:
    """Two-sided p: counted exactly for up to 50 untied differences, else by the normal approximation."""
    if exact and n <= 50:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for k in range(1, n + 1):
            for s in range(len(ways) - 1, k - 1, -1):
                ways[s] += ways[s - k]
        return min(1.0, 2 * sum(ways[: int(stat) + 1]) / 2**n)
    mean = n * (n + 1) / 4
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    if var <= 0:
        return 1.0
    return math.erfc(abs(stat - mean) / math.sqrt(var) / math.sqrt(2))


def holm(tests: DataFrame, order: list[str], p: str = "p_value", strict: bool = False) -> DataFrame:
    """Adds p_holm = min(1, p (m - rank + 1)); ``strict`` adds the running maximum. One row per test: few rows."""
    w = Window.partitionBy().orderBy(p, *order)
    out = tests.withColumn("_rank", F.row_number().over(w)).withColumn("p_holm", F.least(F.lit(1.0), F.col(p) * (F.count("*").over(Window.partitionBy()) - F.col("_rank") + 1)))
    if strict:
        out = out.withColumn("p_holm", F.max("p_holm").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.drop("_rank")


# --- descriptions ---------------------------------------------------------------


def box_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles and whiskers at 1.5 interquartile ranges: (keys, q1, median, q3, whisker_lo, whisker_hi).

    The narrow table of values is written once, as it is read for the quartiles and for the whiskers.
    """
    rows = checkpoint(rows.select(*keys, value))
    q = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    v, iqr = F.col(value), F.col("q")[2] - F.col("q")[0]
    near = rows.join(q, keys).where((v >= F.col("q")[0] - 1.5 * iqr) & (v <= F.col("q")[2] + 1.5 * iqr))
    ends = near.groupBy(*keys).agg(F.min(value).alias("whisker_lo"), F.max(value).alias("whisker_hi"))
    return q.join(ends, keys).select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "whisker_lo", "whisker_hi")
