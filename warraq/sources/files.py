"""Reading transcription trees, pairing files, and scanning tables with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warraq.functions.normalize import nfc
from warraq.operators.corpus import variant_names
from warraq.session import small


def read_texts(spark: SparkSession, path: str, glob: str = "*.txt", strict: bool = False) -> DataFrame:
    """(path, name, text) of a tree: UTF-8 with invalid bytes replaced (or refused), line ends unified."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    text = F.validate_utf8(F.col("content").cast("string")) if strict else F.make_valid_utf8(F.col("content").cast("string"))
    return files.select("path", file_name(F.col("path")).alias("name"), F.regexp_replace(text, "\r\n?", "\n").alias("text"))


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """(system, variant, n, path, text) of a tree <system>/<variant>/image_<n>.txt; other files are passed over.

    ``path`` sorts as the files do by name (image_1, image_10, image_2).
    """
    files = read_texts(spark, path, "image_*.txt")
    part = lambda i: F.regexp_extract("path", r"([^/]+)/([^/]+)/image_(\d+)\.txt$", i)
    out = files.select(part(1).alias("system"), part(2).alias("variant"), part(3).try_cast("int").alias("n"), "path", "text")
    return out.where("n is not null").withColumns({"system": F.try_url_decode("system"), "variant": F.try_url_decode("variant")})


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, content), n being the number in an image's name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    n = F.regexp_extract(file_name(F.col("path")), r"(\d+)\.(?:jpe?g|png)$", 1).try_cast("int")
    return files.select("path", n.alias("n"), "content").where("n is not null")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table with quoted line ends and doubled quotes, under a declared schema."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"')


def candidates(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """(n, source, name, priority): every file name a page may have, best first.

    ``templates`` holds (source, template, ord), a handful of rows.
    """
    names = pages.select("n").distinct().crossJoin(small(templates)).select("n", "source", "ord", F.posexplode(variant_names(F.col("template"), F.col("n"))).alias("v", "name"))
    return names.select("n", "source", nfc("name").alias("name"), (F.col("ord") * 10 + F.col("v")).alias("priority"))


def resolve(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first existing file of each page and source: (n, source, name, path). Names compare after composition."""
    there = files.select(nfc(file_name(F.col("path"))).alias("name"), "path")
    hit = wanted.join(there, "name")
    return hit.groupBy("n", "source").agg(F.min_by(F.struct("name", "path"), F.struct("priority", "path")).alias("f")).select("n", "source", "f.name", "f.path")


def gold_pairs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gold files with their recognised partners (gold, ocr), and the gold names without one."""
    names = files.select("name").distinct()
    gold = names.where(F.col("name").endswith(".txt") & F.col("name").contains("gold")).select(F.col("name").alias("gold"), F.replace("name", F.lit("_gold"), F.lit("")).alias("ocr"))
    other = names.select(F.col("name").alias("ocr"))
    return gold.join(other, "ocr").where("gold != ocr").select("gold", "ocr"), gold.join(other.join(gold.select(F.col("gold").alias("ocr")), "ocr", "left_anti"), "ocr", "left_anti").select("gold")


def third_reader(text: Column) -> Column:
    """An annotator's template without its comment lines, stripped."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.startswith(x, F.lit("#")))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")
