"""Memorisation probe: does a predicted continuation repeat the unseen half of a page?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.functions.metrics import with_jaccard
from warraq.functions.normalize import is_unknown, lower_half, preprocess, present, split_response
from warraq.operators.corpus import subset
from warraq.schema import MARKER, PRIVATE_REPOSITORY


def probe_rows(responses: DataFrame, references: DataFrame, provenance: DataFrame, n_gram: int = 5) -> DataFrame:
    """A row per response whose page has a reference: (page_id, n, system, subset, prediction_chars,
    gt_bottom_chars, char_5gram_jaccard, predicted_unknown).

    ``references`` holds (page_id, n, text). A page without provenance counts as public.
    """
    _, tail = split_response(F.col("text"), MARKER)
    asked = responses.where("n is not null").select("system", "n", tail.alias("prediction"))
    refs = references.where("n is not null").select("page_id", "n", lower_half(present(F.col("text"))).alias("bottom"))
    where = provenance.where("n is not null").groupBy("n").agg(F.max("repository").alias("repository"))
    rows = asked.join(refs, "n").join(where, "n", "left")
    rows = rows.withColumn("a", preprocess(F.col("prediction"), "no_tashkeel")).withColumn("b", preprocess(F.col("bottom"), "no_tashkeel"))
    rows = with_jaccard(rows, "char_5gram_jaccard", "a", "b", n_gram)
    return rows.select(
        "page_id", "n", "system", subset(F.col("repository"), PRIVATE_REPOSITORY).alias("subset"), F.length("prediction").alias("prediction_chars"),
        F.length("bottom").alias("gt_bottom_chars"), "char_5gram_jaccard", is_unknown(F.col("prediction")).alias("predicted_unknown"),
    )


def probe_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("system", "subset").agg(F.count("char_5gram_jaccard").alias("n_pages"), F.avg("char_5gram_jaccard").alias("mean_jaccard"), F.avg(F.col("predicted_unknown").cast("double")).alias("unknown_rate"))
