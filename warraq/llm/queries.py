"""Queries of the training-data problems over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.session import read


def _consensus(spark: SparkSession, sf_dir: str):
    from warraq.llm.consensus import Consensus

    calibration = ("page_01",)  # transcribed over and over: each of its rows is a voice
    return Consensus(read(spark, sf_dir, "parallel_corpus", "row_id", "page_id", "system", "text"), pooled=calibration)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).departing()


def p1_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).consensus()


def p1_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).reliability()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_repaired(spark, sf_dir).select("row_id", "field")


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    from warraq.llm.mojibake import garbled_values

    corpus = read(spark, sf_dir, "parallel_corpus", "row_id", "text", "source_path")
    return garbled_values(corpus, "row_id", ("text", "source_path"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from warraq.llm.scannoise import ScanNoise

    return ScanNoise(read(spark, sf_dir, "parallel_corpus", "row_id", "page_id", "system", "text"), keep=False).found()


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from warraq.llm.scannoise import ScanNoise

    return ScanNoise(read(spark, sf_dir, "parallel_corpus", "row_id", "page_id", "system", "text")).paragraphs(unread=True)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from warraq.llm.homoglyph import consistent_form

    corpus = read(spark, sf_dir, "parallel_corpus", "row_id", "text")
    return consistent_form(corpus, "row_id", "text", only_changed=True).select("row_id")


def p4_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from warraq.llm.homoglyph import consistent_form

    return consistent_form(read(spark, sf_dir, "parallel_corpus", "row_id", "text"), "row_id", "text")


_CORPUS = ("row_id", "page_id", "system", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from warraq.llm.truncation import truncated

    return truncated(read(spark, sf_dir, "parallel_corpus", *_CORPUS)).select("row_id")


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from warraq.llm.truncation import rates

    return rates(read(spark, sf_dir, "parallel_corpus", *_CORPUS))


def p5_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from warraq.llm.truncation import endings, limits

    return limits(endings(read(spark, sf_dir, "parallel_corpus", *_CORPUS)))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from warraq.llm.packing import pack
    from warraq.llm.tokens import with_token_counts

    counted = with_token_counts(read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return pack(counted, read(spark, sf_dir, "context_windows"))


def p6_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from warraq.llm.packing import fill

    return fill(_packed(spark, sf_dir))


def _mix(spark: SparkSession, sf_dir: str):
    from warraq.llm.mixing import Mix
    from warraq.llm.tokens import with_token_counts

    counted = with_token_counts(read(spark, sf_dir, "documents", "doc_id", "source", "text"), "doc_id", "text", "source")
    return Mix(counted, read(spark, sf_dir, "mix_targets"))


def p7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen records with their uses, the place of the first in the schedule, and all places as text."""
    chosen = _mix(spark, sf_dir).records()
    return chosen.withColumns({"slot": F.get("slots", F.lit(0)), "slots": F.array_join(F.col("slots").cast("array<string>"), ",")})


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).shares()


def _scored(spark: SparkSession, sf_dir: str, spans: bool = False) -> DataFrame:
    from warraq.llm.toxicity import fit, score

    documents = read(spark, sf_dir, "documents", "doc_id", "text")
    return score(documents, fit(documents, read(spark, sf_dir, "content_review")), spans=spans)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from warraq.llm.toxicity import THRESHOLD

    return _scored(spark, sf_dir).where(F.col("score") >= THRESHOLD).select("doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, spans=True)


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in need of review per source; the null source is a group of its own."""
    from warraq.llm.toxicity import THRESHOLD

    sources = read(spark, sf_dir, "documents", "doc_id", "source")
    hit = F.coalesce(F.col("score") >= THRESHOLD, F.lit(False)).cast("long")
    per = sources.join(_scored(spark, sf_dir), "doc_id", "left").groupBy("source").agg(F.count("*").alias("documents"), F.sum(hit).alias("flagged"))
    return per.withColumn("rate", F.col("flagged") / F.col("documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    from warraq.llm.sql import ORACLE

    return dict(ORACLE)
