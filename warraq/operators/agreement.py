"""Agreement of three annotators: pairwise error rates and coefficients."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from warraq.functions import align
from warraq.functions import metrics as M

PAIRS = ((1, 2), (1, 3), (2, 3))


def pairwise(norm: DataFrame, annotators: tuple[str, str, str], aligned: bool = True) -> DataFrame:
    """(page_id, cer_A1_A2, cer_A1_A3, cer_A2_A3, the same _norm[, alpha]) for pages of all three."""
    texts = {f"a{k}_{m}": F.max(F.when(F.col("system") == s, F.col(f"n_{m}"))) for k, s in enumerate(annotators, 1) for m in ("no_tashkeel", "normalized")}
    have = F.count_distinct("system").alias("_have")
    rows = norm.where(F.col("system").isin(list(annotators))).groupBy("page_id").agg(*[c.alias(k) for k, c in texts.items()], have).where("_have = 3")
    rates = [M.Rate(f"cer_A{x}_A{y}{end}", "cer", f"a{x}_{m}", f"a{y}_{m}") for m, end in (("no_tashkeel", ""), ("normalized", "_norm")) for x, y in PAIRS]
    rows = M.score(rows, rates)
    if not aligned:
        return rows.select("page_id", *[r.name for r in rates])
    rows = rows.withColumn("_alpha", align.alpha(F.array(*[F.col(f"a{k}_no_tashkeel") for k in (1, 2, 3)])))
    return rows.select("page_id", *[r.name for r in rates], F.col("_alpha.alpha").alias("alpha"))


def nominal_alpha(norm: DataFrame, annotators: tuple[str, ...], mode: str = "no_tashkeel") -> DataFrame:
    """(page_id, alpha): nominal coefficient over unaligned positions, shorter texts padded with '*'.

    Coincidences come from counts per position, so nothing grows with pairs of annotators.
    """
    texts = norm.where(F.col("system").isin(list(annotators))).select("page_id", "system", F.replace(f"n_{mode}", F.lit(" "), F.lit("")).alias("t"))
    longest = F.max(F.length("t")).over(Window.partitionBy("page_id"))
    raters = F.count("*").over(Window.partitionBy("page_id"))
    rows = texts.select("page_id", "t", longest.alias("len"), raters.alias("m")).where("m >= 2 and len > 0")
    cells = rows.select("page_id", "m", F.posexplode(F.split(F.rpad("t", F.col("len"), F.lit("*")), "")).alias("pos", "c")).where("c != ''")
    per = cells.groupBy("page_id", "pos", "c").agg(F.count("*").alias("k"), F.first("m").alias("m"))
    same = per.groupBy("page_id").agg(F.sum(F.col("k") * (F.col("k") - 1) / (F.col("m") - 1)).alias("agree"), F.sum("k").alias("n"))
    freq = per.groupBy("page_id", "c").agg(F.sum("k").alias("k")).groupBy("page_id").agg(F.sum(F.col("k") * (F.col("k") - 1)).alias("chance"))
    j = same.join(freq, "page_id")
    expected = F.col("chance") / (F.col("n") - 1)
    return j.select("page_id", F.when(F.col("n") != expected, 1 - (F.col("n") - F.col("agree")) / (F.col("n") - expected)).alias("alpha"))
