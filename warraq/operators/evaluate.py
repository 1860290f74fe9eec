"""Texts of systems scored against one or more human references."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq.functions import align
from warraq.functions import metrics as M
from warraq.schema import LESS_IS_BETTER, METRICS, MORE_IS_BETTER, REFERENCES
from warraq.session import spread

MODES = ("raw", "normalized", "no_tashkeel", "tashkeel_only")


def references(norm: DataFrame, refs: dict[str, str] = REFERENCES) -> DataFrame:
    """Pages that all references hold, one row each, the texts side by side: <ref>_<mode>."""
    modes = [c for c in norm.columns if c.startswith("n_")]
    aggs = [F.max(F.when(F.col("system") == s, F.col(m))).alias(f"{r}_{m[2:]}") for r, s in refs.items() for m in modes]
    have = F.count_distinct(F.when(F.col("system").isin(list(refs.values())), F.col("system")))
    return norm.where(F.col("system").isin(list(refs.values()))).groupBy("page_id").agg(*aggs, have.alias("_have")).where(F.col("_have") == len(refs)).drop("_have")


def pairs(norm: DataFrame, systems: Iterable[str], refs: dict[str, str] = REFERENCES) -> DataFrame:
    """A row for each system's page that all references hold, with hypothesis and reference texts."""
    joined = norm.where(F.col("system").isin(list(systems))).join(references(norm, refs), "page_id")
    return spread(joined, "page_id", "system")


def panel(df: DataFrame, ref: str, metrics: Iterable[str] = METRICS, prefix: str = "") -> DataFrame:
    """Adds the metrics of the hypothesis (n_<mode>) against the reference ``ref`` (<ref>_<mode>)."""
    return panels(df, [ref], metrics, {ref: prefix})


def panels(df: DataFrame, refs: list[str], metrics: Iterable[str], prefix: dict[str, str]) -> DataFrame:
    metrics = list(metrics)
    rates, scores = [], []
    for r in refs:
        for m in metrics:
            kind, _, mode = m.partition("_")
            if kind in ("cer", "wer", "der"):
                mode = mode or "tashkeel_only"
                rates.append(M.Rate(prefix[r] + m, kind, f"{r}_{mode}", f"n_{mode}"))
        if any(m in MORE_IS_BETTER for m in metrics):
            scores.append(r)
    keep = df.columns
    df = df.select("*", *[M.chrf_bleu(f"{r}_no_tashkeel", "n_no_tashkeel").alias(f"_s_{r}") for r in scores])
    df = df.select(*keep, *[F.col(f"_s_{r}.{m.split('_')[0]}").alias(prefix[r] + m) for r in scores for m in metrics if m in MORE_IS_BETTER])
    return M.score(df, rates) if rates else df


def best_of(metric: str, *values: Column) -> Column:
    """The better value, whichever direction is better; nulls lose."""
    return F.least(*values) if metric in LESS_IS_BETTER else F.greatest(*values)


def per_page(pair_rows: DataFrame, metrics: Iterable[str] = METRICS, refs: Iterable[str] = tuple(REFERENCES)) -> DataFrame:
    """(page_id, system, ref, metric...) for each reference and for the best of them."""
    refs, metrics = list(refs), list(metrics)
    scored = panels(pair_rows, refs, metrics, {r: f"{r}__" for r in refs})
    one = lambda r: F.struct(F.lit(r).alias("ref"), *[F.col(f"{r}__{m}").alias(m) for m in metrics])
    best = F.struct(F.lit("best").alias("ref"), *[best_of(m, *[F.col(f"{r}__{m}") for r in refs]).alias(m) for m in metrics])
    return scored.select("page_id", "system", F.explode(F.array(*[one(r) for r in refs], best)).alias("s")).select("page_id", "system", "s.*")


def disagreement_zones(both: DataFrame, a: str = "muhammad", b: str = "hasan") -> DataFrame:
    """Where two annotators differ, spaces kept: lengths, edit distance and its share of the longer text."""
    x, y = f"{a}_no_tashkeel", f"{b}_no_tashkeel"
    df = M.score(both.select("page_id", x, y), [M.Rate("edit_distance_m_h", "distance", x, y)])
    longest = F.greatest(F.length(x), F.length(y), F.lit(1))
    return df.select("page_id", F.length(x).alias("m_len_no_tashkeel"), F.length(y).alias("h_len_no_tashkeel"), "edit_distance_m_h", (F.col("edit_distance_m_h") / longest).alias("char_disagreement_rate"))


def typology(pair_rows: DataFrame, refs: Iterable[str] = tuple(REFERENCES), mode: str = "normalized") -> DataFrame:
    """(system, ref, klass, n): edits by class."""
    one = [pair_rows.select("system", F.lit(r).alias("ref"), F.explode(align.class_counts(f"{r}_{mode}", f"n_{mode}")).alias("c")) for r in refs]
    rows = one[0]
    for x in one[1:]:
        rows = rows.unionByName(x)
    return rows.groupBy("system", "ref", "c.klass").agg(F.sum("c.n").alias("n"))


def typology_counts(long: DataFrame, classes: Iterable[str]) -> DataFrame:
    """Wide form: total_edits (1 if there are none), then count and share of each class."""
    total = F.greatest(F.sum("n"), F.lit(1))
    count = lambda k: F.coalesce(F.sum(F.when(F.col("klass") == k, F.col("n"))), F.lit(0))
    cols = [c for k in classes for c in (count(k).alias(f"{k}_count"), (count(k) / total).alias(f"{k}_share"))]
    return long.groupBy("system", "ref").agg(total.alias("total_edits"), *cols)


def typology_examples(pair_rows: DataFrame, refs: Iterable[str] = tuple(REFERENCES), mode: str = "normalized", most: int = 10, seed: int = 0) -> DataFrame:
    """Up to ``most`` edits of each class, system and reference, drawn by a seeded hash of their place.

    Every page keeps its first ``most`` of a class before anything is shuffled.
    """
    from pyspark.sql.window import Window

    out = None
    for r in refs:
        e = pair_rows.select("page_id", "system", F.lit(r).alias("ref"), F.posexplode(align.edit_ops(f"{r}_{mode}", f"n_{mode}")).alias("pos", "e"))
        e = e.select("page_id", "system", "ref", "pos", "e.op", "e.a", "e.b", align.klass_column(F.col("e.op"), F.col("e.a"), F.col("e.b")).alias("klass"))
        out = e if out is None else out.unionByName(e)
    out = out.withColumn("_h", F.xxhash64("page_id", "pos", F.lit(seed)))
    slices = Window.partitionBy("system", "ref", "klass", F.pmod("_h", F.lit(64))).orderBy("_h", "page_id", "pos")
    few = out.withColumn("_r", F.row_number().over(slices)).where(F.col("_r") <= most)
    whole = Window.partitionBy("system", "ref", "klass").orderBy("_h", "page_id", "pos")
    return few.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= most).select("system", "ref", "klass", "page_id", "op", "a", "b")


def consensus_only(pair_rows: DataFrame, a: str = "muhammad", b: str = "hasan") -> DataFrame:
    """(page_id, system, n_consensus_chars, cer_consensus): errors where both annotators agree."""
    c = align.consensus(f"{a}_no_tashkeel", f"{b}_no_tashkeel", "n_no_tashkeel")
    return pair_rows.select("page_id", "system", c.alias("c")).select("page_id", "system", F.col("c.n").alias("n_consensus_chars"), F.col("c.cer").alias("cer_consensus"))


def diacritics(pair_rows: DataFrame, ref: str = "muhammad") -> DataFrame:
    """(page_id, system, der_bounded, precision, recall, f1) against one reference."""
    p = align.prf(f"{ref}_normalized", "n_normalized")
    df = M.score(pair_rows, [M.Rate("der_bounded", "der_bounded", f"{ref}_tashkeel_only", "n_tashkeel_only")])
    return df.select("page_id", "system", "der_bounded", p.alias("p")).select(
        "page_id", "system", "der_bounded", F.col("p.precision").alias("diacritic_precision"), F.col("p.recall").alias("diacritic_recall"), F.col("p.f1").alias("diacritic_f1")
    )


__all__ = ["MORE_IS_BETTER", "best_of", "consensus_only", "diacritics", "disagreement_zones", "pairs", "panel", "panels", "per_page", "references", "typology", "typology_counts", "typology_examples"]
