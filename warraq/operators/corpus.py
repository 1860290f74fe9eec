"""The parallel corpus as a table: one text per page and system, and what is there or missing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq.functions.normalize import mode_columns, nfc, present
from warraq.schema import SYSTEMS
from warraq.session import small


def latest(corpus: DataFrame) -> DataFrame:
    """The text delivered last for each page and system: (page_id, system, text).

    Re-ingested copies and the many deliveries of a calibration page collapse before anything is
    joined; the aggregate combines on the map side, so a hot page is no heavier than others.
    """
    order = F.struct("ingested_at", "row_id")
    return corpus.where("page_id is not null and system is not null").groupBy("page_id", "system").agg(F.max_by("text", order).alias("text"))


def page_number(page_id: Column) -> Column:
    return F.regexp_extract(page_id, r"^page_(\d+)$", 1).try_cast("int")


def page_id(n: Column) -> Column:
    return F.format_string("page_%02d", n)


def normalized(texts: DataFrame, *modes: str) -> DataFrame:
    """(page_id, system, n_<mode>...) with every text normalised once, whatever it is compared with."""
    cols = mode_columns(F.col("_nfc"))
    return texts.select("page_id", "system", nfc(present(F.col("text"))).alias("_nfc")).select("page_id", "system", *[cols[m].alias(f"n_{m}") for m in modes])


def manifest(texts: DataFrame, systems: Iterable[str] = SYSTEMS) -> DataFrame:
    """One row per page with a flag for each system: (page_id, has_<system>...)."""
    return texts.groupBy("page_id").agg(*[F.coalesce(F.max(F.col("system") == s), F.lit(False)).alias(f"has_{s}") for s in systems])


def coverage(texts: DataFrame, systems: DataFrame, pages: DataFrame) -> DataFrame:
    """(system, pages, coverage) for every listed system, those without a page included."""
    n = texts.groupBy("system").agg(F.count("*").alias("pages"))
    total = pages.agg(F.countDistinct("page_id").alias("_total"))
    out = systems.join(n, "system", "left").crossJoin(F.broadcast(total))
    return out.select("system", F.coalesce("pages", F.lit(0)).alias("pages"), (F.coalesce("pages", F.lit(0)) / F.greatest("_total", F.lit(1))).alias("coverage"))


def missing(texts: DataFrame, systems: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, system) that were expected and not delivered."""
    plan = pages.select("page_id").distinct().crossJoin(small(systems.select("system")))
    return plan.join(texts.select("page_id", "system"), ["page_id", "system"], "left_anti")


def run_plan(pages: DataFrame, systems: DataFrame, variants: DataFrame, done: DataFrame) -> DataFrame:
    """(system, variant, n) still to run: the product of a list of pages with short lists, less what is there."""
    plan = pages.select("n").where("n is not null").distinct().crossJoin(small(systems.select("system"))).crossJoin(small(variants.select("variant")))
    return plan.join(done.select("system", "variant", "n"), ["system", "variant", "n"], "left_anti")


def parse_pages(spec: Column) -> Column:
    """Distinct sorted page numbers of a list like ``1-3,7``; malformed parts are left out."""
    part = lambda p, i: F.regexp_extract(p, r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$", i).try_cast("int")
    one = F.transform(F.split(spec, ","), lambda p: F.when(part(p, 1).isNull(), F.array().cast("array<int>")).otherwise(F.sequence(part(p, 1), F.greatest(part(p, 1), F.coalesce(part(p, 2), part(p, 1))))))
    return F.array_sort(F.array_distinct(F.flatten(one)))


def variant_names(template: Column, n: Column) -> Column:
    """File names of a template with ``{n}`` or ``{n_variants}``: plain, two and three digits, once each."""
    forms = F.array(n.cast("string"), F.format_string("%02d", n), F.format_string("%03d", n))
    return F.array_distinct(F.transform(forms, lambda v: F.replace(F.replace(template, F.lit("{n_variants}"), v), F.lit("{n}"), v)))


def subset(repository: Column, private: str) -> Column:
    return F.when(repository == private, "private").otherwise("public")


def stratified_pick(labels: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Exactly ``target`` pages of each class in the order of a seeded hash: (page_id, difficulty).

    Every page counts once; classes without a target and null classes give nothing. Only the best
    few rows of a class ever meet in one task, as each task keeps no more than the largest target.
    """
    import pandas as pd

    largest = targets.agg(F.max("target").alias("t")).first()["t"] or 0
    once = labels.where("difficulty is not null and page_id is not null").select("page_id", "difficulty").distinct()
    keyed = once.join(small(targets), "difficulty").withColumn("_h", F.md5(F.concat_ws(":", "page_id", F.lit(str(seed)))))

    def top(batches):
        best: dict[str, list] = {}
        for pdf in batches:
            for d, p, t, h in pdf[["difficulty", "page_id", "target", "_h"]].itertuples(index=False):
                best.setdefault(d, []).append((h, p, t))
            best = {d: sorted(v)[:largest] for d, v in best.items()}
        yield pd.DataFrame([(d, p, t, h) for d, v in best.items() for h, p, t in v], columns=["difficulty", "page_id", "target", "_h"])

    from pyspark.sql.window import Window

    few = keyed.mapInPandas(top, "difficulty string, page_id string, target int, _h string")
    rank = F.row_number().over(Window.partitionBy("difficulty").orderBy("_h", "page_id"))
    return few.withColumn("_rank", rank).where("_rank <= target").select("page_id", "difficulty")
