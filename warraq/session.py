"""Session helpers: shared checkpoints, hot keys, and salted joins."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing to the shared checkpoint folder.

    The cluster names the folder in ``spark.checkpoint.dir``; a folder of our own
    is set only where none is named and the master is local, as in tests: the executors of a
    cluster don't share it.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="warraq-"))
    return df.checkpoint()


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle over all tasks before work that is heavy for its bytes.

    Adaptive execution sizes partitions by bytes and would hand a few megabytes of text, and with it
    minutes of edit distances, to a single task; an explicit number of partitions stands.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """The table marked for broadcast, its size checked: it may hold ``most`` rows, else it is left to a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def hot_keys(df: DataFrame, key: str, rows_per_salt: int = 4_000, most: int = 10_000) -> DataFrame:
    """Keys that need more than one salt, with the number of salts.

    A key is hot from ``rows_per_salt`` rows on, or from a ``most``-th of all rows where that is more. So
    at most ``most`` keys come out, with at most twice as many salts, and the result may be broadcast
    whatever the input size; no key above the threshold is left out. Null keys never match and are none.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("_rows"))
    least = counts.agg(F.greatest(F.lit(rows_per_salt), F.ceil(F.sum("_rows") / most)).alias("_least"))
    hot = counts.where(F.col(key).isNotNull()).crossJoin(F.broadcast(least)).where(F.col("_rows") > F.col("_least"))
    return hot.select(key, F.ceil(F.col("_rows") / F.col("_least")).cast("int").alias("_salts"))


#: Salts over which rows with a null key are spread.
NULL_SALTS = 1024


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, spread: str, how: str = "left") -> DataFrame:
    """Join ``right`` (one row per key) to ``left``, splitting hot keys over salts.

    ``hot`` comes from :func:`hot_keys`; ``spread`` is a column of ``left`` that varies
    within a key. Only the few hot keys of ``right`` are replicated. Rows of ``left`` without a key match
    nothing and are spread evenly.
    """
    salts = F.when(F.col(key).isNull(), F.lit(NULL_SALTS)).otherwise(F.coalesce("_salts", F.lit(1)))
    a = left.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int"))
    b = (
        right.where(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    return a.drop("_salts").join(b, [key, "_salt"], how).drop("_salt")
