"""The engine's own operators as queries over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from warraq import schema as S
from warraq.functions import align
from warraq.functions import metrics as M
from warraq.functions import normalize as N
from warraq.operators import agreement, evaluate, probe, stats
from warraq.operators import corpus as C
from warraq.session import read, spread
from warraq.sources import sinks

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from warraq.plans.sql import ORACLE

    return {k: v for k, v in ORACLE.items() if k in _QUERIES}


# --- shared steps ---------------------------------------------------------------


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return C.latest(read(spark, d, "parallel_corpus", "page_id", "system", "text", "ingested_at", "row_id"))


def _names(spark: SparkSession, values: tuple[str, ...], column: str = "system") -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def _pairs(spark: SparkSession, d: str, *modes: str) -> DataFrame:
    return evaluate.pairs(C.normalized(_latest(spark, d), *modes), S.SYSTEMS)


def _cer(spark: SparkSession, d: str, *metrics: str) -> DataFrame:
    """Per-page scores of the given metrics only."""
    metrics = metrics or ("cer_no_tashkeel",)
    modes = sorted({m.split("_", 1)[1] if "_" in m else "tashkeel_only" for m in metrics})
    return evaluate.per_page(_pairs(spark, d, *modes), metrics)


def _unit(page_id: str = "page_id") -> Column:
    return F.coalesce(C.page_number(F.col(page_id)), F.lit(0))



def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _difficulty(spark: SparkSession, d: str) -> DataFrame:
    """One label a page; a page with several keeps the first in order."""
    return read(spark, d, "difficulty_labels", "page_id", "difficulty").where("difficulty is not null").groupBy("page_id").agg(F.min("difficulty").alias("difficulty"))


def _subsets(spark: SparkSession, d: str) -> DataFrame:
    prov = read(spark, d, "manuscript_provenance", "page_id", "repository").groupBy("page_id").agg(F.max("repository").alias("repository"))
    return prov.select("page_id", C.subset(F.col("repository"), S.PRIVATE_REPOSITORY).alias("subset"))


# --- flagship ---------------------------------------------------------------------


def flagship(spark: SparkSession, d: str) -> DataFrame:
    rows = _cer(spark, d).where("ref = 'best'")
    return _rounded(rows.groupBy("system").agg(F.count("*").alias("n_pages"), F.avg("cer_no_tashkeel").alias("cer_no_tashkeel_mean")))


@query
def q_flagship(spark, d):
    return flagship(spark, d)


# --- corpus, manifest, plans ------------------------------------------------------


@query
def q_corpus_long(spark, d):
    t = _latest(spark, d)
    return t.select("page_id", "system", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


@query
def q_manifest(spark, d):
    return C.manifest(_latest(spark, d))


@query
def q_coverage(spark, d):
    return _rounded(C.coverage(_latest(spark, d), _names(spark, (*S.SYSTEMS, *S.REFERENCES.values(), "qalam")), read(spark, d, "manifest", "page_id")))


@query
def q_missing(spark, d):
    return C.missing(_latest(spark, d), _names(spark, (*S.SYSTEMS, *S.REFERENCES.values())), read(spark, d, "manifest", "page_id"))


@query
def q_missing_first(spark, d):
    """The report's first twenty missing files and how many there are in all (a top-k report)."""
    gone = q_missing(spark, d)
    return gone.orderBy("system", "page_id").limit(20).crossJoin(gone.agg(F.count("*").alias("missing")))


@query
def q_run_plan(spark, d):
    done = read(spark, d, "prompt_ablation_outputs", "system", "variant", "n")
    return C.run_plan(read(spark, d, "manifest", "n"), done.select("system").distinct(), _names(spark, ("v1", "v2", "v3"), "variant"), done)


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(source, t, i) for source, ts in S.TEMPLATES.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "source string, template string, ord int")


@query
def q_file_names(spark, d):
    """Candidate file names of every page and source, best first."""
    from warraq.sources.files import candidates

    return candidates(read(spark, d, "manifest", "n"), _templates(spark))


@query
def q_resolve_files(spark, d):
    """The file that serves each page of each source, found among the delivered paths."""
    from warraq.sources.files import candidates, resolve

    files = read(spark, d, "parallel_corpus", "source_path").where("source_path is not null").select(F.col("source_path").alias("path")).distinct()
    return resolve(files, candidates(read(spark, d, "manifest", "n"), _templates(spark)))


# --- normalisation ----------------------------------------------------------------


def _mode(name: str):
    def run(spark, d):
        t = read(spark, d, "parallel_corpus", "row_id", "text")
        return t.select("row_id", N.preprocess(F.col("text"), name).alias("text"))

    run.__name__ = f"q_norm_{name}"
    return run


for _name in ("raw", "normalized", "no_tashkeel", "tashkeel_only"):
    query(_mode(_name))


@query
def q_norm_evaluator(spark, d):
    t = read(spark, d, "parallel_corpus", "row_id", "text")
    return t.select("row_id", N.evaluator_normalize(F.col("text")).alias("text"))


@query
def q_token_counts(spark, d):
    t = read(spark, d, "parallel_corpus", "row_id", "text").select("row_id", N.preprocess(F.col("text"), "no_tashkeel").alias("t"))
    return t.select("row_id", F.length(N.char_tokens(F.col("t"))).alias("chars"), F.size(N.word_tokens(F.col("t"))).alias("words"))


@query
def q_response_split(spark, d):
    t = read(spark, d, "contamination_responses", "system", "n", "text")
    head, tail = N.split_response(F.col("text"), S.MARKER)
    return t.select("system", "n", head.alias("visible"), tail.alias("continuation"), N.is_unknown(tail).alias("predicted_unknown"))


@query
def q_half_split(spark, d):
    t = _latest(spark, d)
    return t.select("page_id", "system", N.lower_half(N.present(F.col("text"))).alias("bottom"))


@query
def q_subset(spark, d):
    t = read(spark, d, "manuscript_provenance", "page_id", "repository")
    return t.select("page_id", C.page_number(F.col("page_id")).alias("number"), C.subset(F.col("repository"), S.PRIVATE_REPOSITORY).alias("subset"))


# --- scores of pairs ----------------------------------------------------------------


@query
def q_cer_pages(spark, d):
    return _rounded(_cer(spark, d, "cer_raw", "cer_normalized", "cer_no_tashkeel"))


@query
def q_wer_pages(spark, d):
    return _rounded(_cer(spark, d, "wer_normalized", "wer_no_tashkeel"))


@query
def q_der_pages(spark, d):
    return _rounded(_cer(spark, d, "der"))


@query
def q_der_bounded(spark, d):
    p = M.score(_pairs(spark, d, "tashkeel_only"), [M.Rate("der_bounded", "der_bounded", "muhammad_tashkeel_only", "n_tashkeel_only")])
    return _rounded(p.select("page_id", "system", "der_bounded"))


@query
def q_chrf_bleu(spark, d):
    return _rounded(_cer(spark, d, "chrf_no_tashkeel", "bleu_no_tashkeel"))


@query
def q_per_page_metrics(spark, d):
    return _rounded(evaluate.per_page(_pairs(spark, d, *evaluate.MODES)))


@query
def q_disagreement_zones(spark, d):
    return _rounded(evaluate.disagreement_zones(evaluate.references(C.normalized(_latest(spark, d), "no_tashkeel")))).orderBy("page_id")


@query
def q_cer_all_rows(spark, d):
    """Every delivery of a recognizer, repeated ones of the calibration page included, against the latest annotators' texts."""
    from warraq.session import hot_keys, salted_join

    rows = read(spark, d, "parallel_corpus", "row_id", "page_id", "system", "text").where(F.col("system").isin(list(S.SYSTEMS)))
    rows = rows.select("row_id", "page_id", "system", N.preprocess(F.col("text"), "no_tashkeel").alias("h"))
    refs = evaluate.references(C.normalized(_latest(spark, d), "no_tashkeel"))
    x = spread(salted_join(rows, refs, "page_id", hot_keys(rows, "page_id"), "row_id", "inner"), "row_id")
    x = M.score(x, [M.Rate("cer_vs_muhammad", "cer", "muhammad_no_tashkeel", "h"), M.Rate("cer_vs_hasan", "cer", "hasan_no_tashkeel", "h")])
    return _rounded(x.select("row_id", "page_id", "system", "cer_vs_muhammad", "cer_vs_hasan", F.least("cer_vs_muhammad", "cer_vs_hasan").alias("cer_best")))


def _evaluator_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each system's page beside either annotator's text, in the evaluator's form: (page_id, system, ref, r, t)."""
    t = _latest(spark, d).select("page_id", "system", N.evaluator_normalize(F.col("text")).alias("t"))
    name = F.create_map(*[F.lit(x) for r, s in S.REFERENCES.items() for x in (s, r)])
    ref = t.where(F.col("system").isin(list(S.REFERENCES.values()))).select("page_id", name[F.col("system")].alias("ref"), F.col("t").alias("r"))
    return spread(t.where(F.col("system").isin(list(S.SYSTEMS))).join(ref, "page_id"), "page_id", "system")


@query
def q_char_sdi(spark, d):
    """Substitutions, deletions and insertions of each page against either annotator, as the evaluator counts them."""
    x = _evaluator_pairs(spark, d).select("page_id", "system", "ref", N.char_tokens(F.col("r")).alias("r"), N.char_tokens(F.col("t")).alias("t")).withColumn("c", align.char_sdi("r", "t"))
    errors = F.col("c.s") + F.col("c.d") + F.col("c.i")
    return x.select("page_id", "system", "ref", errors.alias("errors"), (F.col("c.d") - F.col("c.i")).alias("deletions_less_insertions"), F.round(F.when(F.length("r") > 0, errors / F.length("r")).otherwise(0.0), 6).alias("cer"))


@query
def q_word_sdi(spark, d):
    x = _evaluator_pairs(spark, d).withColumn("c", align.word_sdi("r", "t"))
    n = F.size(N.word_tokens(F.col("r")))
    return x.select("page_id", "system", "ref", F.col("c.s").alias("s"), F.col("c.d").alias("d"), F.col("c.i").alias("i"), F.round(F.when(n > 0, (F.col("c.s") + F.col("c.d") + F.col("c.i")) / n).otherwise(0.0), 6).alias("wer"))


@query
def q_word_errors(spark, d):
    """The totals of q_word_sdi, which no tie between edit scripts changes."""
    x = q_word_sdi(spark, d)
    return x.select("page_id", "system", "ref", (F.col("s") + F.col("d") + F.col("i")).alias("errors"), (F.col("d") - F.col("i")).alias("deletions_less_insertions"), "wer")


@query
def q_edit_lists(spark, d):
    """The characters that were substituted, deleted and inserted, with how often: (system, ref, op, a, b, n)."""
    x = _evaluator_pairs(spark, d).select("system", "ref", F.explode(align.edit_ops(N.char_tokens(F.col("r")), N.char_tokens(F.col("t")))).alias("e"))
    return x.groupBy("system", "ref", "e.op", "e.a", "e.b").agg(F.count("*").alias("n"))


@query
def q_consensus_pages(spark, d):
    return _rounded(evaluate.consensus_only(_pairs(spark, d, "no_tashkeel")))


@query
def q_diacritic_prf(spark, d):
    return _rounded(evaluate.diacritics(_pairs(spark, d, "normalized", "tashkeel_only")))


@query
def q_typology_counts(spark, d):
    return _rounded(evaluate.typology_counts(evaluate.typology(_pairs(spark, d, "normalized")), S.EDIT_CLASSES))


@query
def q_typology_totals(spark, d):
    """Edits of all classes: however ties fall, as many as the distance."""
    x = q_typology_counts(spark, d)
    return x.select("system", "ref", "total_edits", sum((F.col(f"{k}_count") for k in S.EDIT_CLASSES), F.lit(0)).cast("long").alias("sum_of_classes"))


@query
def q_typology_raw(spark, d):
    """The same over raw texts, where all classes can occur."""
    return _rounded(evaluate.typology_counts(evaluate.typology(_pairs(spark, d, "raw"), mode="raw"), S.EDIT_CLASSES))


@query
def q_typology_examples(spark, d):
    return evaluate.typology_examples(_pairs(spark, d, "normalized"), seed=S.SEED)


@query
def q_report_md(spark, d):
    """A markdown report of each system's page against the first annotator, with the edits listed."""
    x = _evaluator_pairs(spark, d).where("ref = 'muhammad'")
    x = x.withColumn("c", align.edit_ops(N.char_tokens(F.col("r")), N.char_tokens(F.col("t")))).withColumn("w", align.word_ops("r", "t"))
    name = F.concat_ws(" ", "page_id", "system")
    return x.select("page_id", "system", sinks.report_text(name, F.length(N.char_tokens(F.col("r"))), F.col("c"), F.size(N.word_tokens(F.col("r"))), F.col("w")).alias("report"))


# --- summaries ----------------------------------------------------------------------


@query
def q_summary_per_system(spark, d):
    rows = evaluate.per_page(_pairs(spark, d, *evaluate.MODES))
    return _rounded(stats.summarize(rows, ["system", "ref"], list(S.METRICS), _unit()))


@query
def q_summary_wide(spark, d):
    long = stats.summarize(_cer(spark, d, "cer_no_tashkeel", "cer_normalized"), ["system", "ref"], ["cer_no_tashkeel", "cer_normalized"], _unit())
    return _rounded(stats.widen(long, ["system", "ref"], ["cer_no_tashkeel", "cer_normalized"]))


@query
def q_summary_ci(spark, d):
    return _rounded(stats.summarize(_cer(spark, d), ["system", "ref"], ["cer_no_tashkeel"], _unit()))


@query
def q_summary_difficulty(spark, d):
    rows = evaluate.per_page(_pairs(spark, d, *evaluate.MODES)).join(_difficulty(spark, d), "page_id")
    return _rounded(stats.summarize(rows, ["system", "ref", "difficulty"], list(S.METRICS), _unit()))


@query
def q_subset_means(spark, d):
    """Means by subset and over all pages in one pass of grouping sets; pages without provenance count in 'all' alone."""
    rows = _cer(spark, d).join(_subsets(spark, d), "page_id", "left")
    sets = rows.groupingSets([["system", "ref", "subset"], ["system", "ref"]], "system", "ref", "subset")
    out = sets.agg(F.grouping("subset").alias("_all"), F.count("*").alias("n_pages"), F.avg("cer_no_tashkeel").alias("mean"))
    return _rounded(out.where("_all = 1 or subset is not null").withColumn("subset", F.when(F.col("_all") == 1, "all").otherwise(F.col("subset"))).drop("_all"))


@query
def q_revision_stratified(spark, d):
    rows = _cer(spark, d, "cer_no_tashkeel", "cer_normalized").join(_subsets(spark, d), "page_id", "left")
    both = rows.withColumn("subset", F.explode(F.array_compact(F.array(F.lit("all"), "subset"))))
    return _rounded(stats.summarize(both, ["system", "ref", "subset"], ["cer_no_tashkeel", "cer_normalized"], _unit()))


@query
def q_outlier_sensitivity(spark, d):
    """Means and intervals without the outlier pages, and how far the mean moves from that of all pages."""
    metrics = list(S.OUTLIER_METRICS)
    rows = _cer(spark, d, *metrics).where("ref = 'best'")
    some = ~F.col("page_id").isin(list(S.OUTLIER_PAGES))
    rows = rows.select("page_id", "system", *metrics, F.explode(F.array_compact(F.array(F.lit("all"), F.when(some, "excl")))).alias("pages"))
    s = stats.summarize(rows, ["system", "pages"], metrics, _unit())
    at = lambda pages, c: F.max(F.when(F.col("pages") == pages, F.col(c)))
    out = s.groupBy("system", "metric").agg(at("excl", "n_pages").alias("n_pages"), at("excl", "mean").alias("mean_excl"), at("excl", "ci_lo").alias("ci_lo_excl"), at("excl", "ci_hi").alias("ci_hi_excl"), (at("excl", "mean") - at("all", "mean")).alias("delta"))
    return _rounded(out)


@query
def q_consensus_summary(spark, d):
    rows = evaluate.consensus_only(_pairs(spark, d, "no_tashkeel")).where("cer_consensus is not null")
    return _rounded(stats.summarize(rows, ["system"], ["cer_consensus"], _unit()))


@query
def q_der_summary(spark, d):
    """Diacritics of the systems, and of the second annotator as one more of them, against the first."""
    rows = evaluate.diacritics(evaluate.pairs(C.normalized(_latest(spark, d), "normalized", "tashkeel_only"), (*S.SYSTEMS, "gt_hasan")))
    return _rounded(stats.summarize(rows, ["system"], ["der_bounded", "diacritic_precision", "diacritic_recall", "diacritic_f1"], _unit()))


@query
def q_der_bounded_summary(spark, d):
    """The bounded diacritic rate of the systems, and of the second annotator as one more of them, against the first."""
    rows = evaluate.pairs(C.normalized(_latest(spark, d), "tashkeel_only"), (*S.SYSTEMS, "gt_hasan"))
    rows = M.score(rows, [M.Rate("der_bounded", "der_bounded", "muhammad_tashkeel_only", "n_tashkeel_only")])
    return _rounded(stats.summarize(rows, ["system"], ["der_bounded"], _unit()))


@query
def q_bootstrap_numpy(spark, d):
    """Intervals by n draws from numpy's own generator, re-seeded for every group, pages in their order."""
    return _rounded(stats.summarize_numpy(_cer(spark, d).where("ref = 'best'"), ["system"], "cer_no_tashkeel", "page_id"))


def _iaa(spark: SparkSession, d: str, *metrics: str) -> DataFrame:
    p = evaluate.pairs(C.normalized(_latest(spark, d), *evaluate.MODES), ("gt_hasan",), {"muhammad": "gt_muhammad"})
    return evaluate.panel(p, "muhammad", metrics).select("page_id", *metrics)


@query
def q_iaa_per_page(spark, d):
    return _rounded(_iaa(spark, d, *S.METRICS))


@query
def q_iaa_cer(spark, d):
    return _rounded(_iaa(spark, d, "cer_raw", "cer_normalized", "cer_no_tashkeel", "der"))


@query
def q_iaa_summary(spark, d):
    rows = _iaa(spark, d, *S.METRICS).withColumn("comparison", F.lit("hasan_vs_muhammad"))
    return _rounded(stats.widen(stats.summarize(rows, ["comparison"], list(S.METRICS), _unit()), ["comparison"], S.METRICS))


@query
def q_iaa_by_difficulty(spark, d):
    """Mean disagreement of the two annotators by difficulty; pages without a label are a group of their own."""
    rows = _iaa(spark, d, "cer_no_tashkeel").join(_difficulty(spark, d), "page_id", "left")
    return _rounded(rows.groupBy("difficulty").agg(F.count("*").alias("n_pages"), F.avg("cer_no_tashkeel").alias("mean")))


@query
def q_prompt_ablation(spark, d):
    """Error rates of the distinct ablation outputs against both annotators; empty outputs are skipped."""
    out = read(spark, d, "prompt_ablation_outputs", "system", "variant", "n", "text").where("text is not null and text != '' and n is not null").distinct()
    hyp = out.select("system", "variant", "n", N.preprocess(F.col("text"), "no_tashkeel").alias("h"))
    norm = C.normalized(_latest(spark, d), "no_tashkeel").withColumn("n", C.page_number(F.col("page_id")))
    ref = lambda s, a: norm.where(F.col("system") == s).select("n", F.col("n_no_tashkeel").alias(a))
    x = hyp.join(ref("gt_muhammad", "m"), "n", "left").join(ref("gt_hasan", "g"), "n", "left")
    x = M.score(x, [M.Rate("cer_vs_muhammad", "cer", "m", "h"), M.Rate("cer_vs_hasan", "cer", "g", "h")])
    x = x.select("system", "variant", "n", F.md5("h").alias("digest"), "cer_vs_muhammad", "cer_vs_hasan")
    return _rounded(x.withColumn("cer_best_of_two", F.least("cer_vs_muhammad", "cer_vs_hasan")))


@query
def q_prompt_ablation_summary(spark, d):
    rows = q_prompt_ablation(spark, d)
    return _rounded(stats.summarize(rows, ["system", "variant"], ["cer_vs_muhammad", "cer_vs_hasan", "cer_best_of_two"], F.col("n")))


@query
def q_wilcoxon(spark, d):
    rows = _cer(spark, d).where("ref = 'best'")
    tests = stats.wilcoxon(stats.system_pairs(rows, "cer_no_tashkeel", list(S.SYSTEMS)), ["system_a", "system_b", "ord"])
    return _rounded(stats.holm(tests, ["ord"])).orderBy("p_value", "ord").drop("ord")


@query
def q_wilcoxon_stat(spark, d):
    rows = _cer(spark, d).where("ref = 'best'")
    tests = stats.wilcoxon(stats.system_pairs(rows, "cer_no_tashkeel", list(S.SYSTEMS)), ["system_a", "system_b"])
    return _rounded(tests.drop("p_value"))


# --- agreement and probe --------------------------------------------------------------


@query
def q_third_annotator(spark, d):
    norm = C.normalized(_latest(spark, d), "no_tashkeel", "normalized")
    return _rounded(agreement.pairwise(norm, ("gt_muhammad", "gt_hasan", S.THIRD_ANNOTATOR), aligned=False))


@query
def q_aligned_alpha(spark, d):
    """(page_id, alpha): the coefficient over characters aligned with the longest of three annotators' texts."""
    norm = C.normalized(_latest(spark, d), "no_tashkeel", "normalized")
    return _rounded(agreement.pairwise(norm, ("gt_muhammad", "gt_hasan", S.THIRD_ANNOTATOR)).select("page_id", "alpha"))


@query
def q_third_annotator_means(spark, d):
    x = q_third_annotator(spark, d)
    return _rounded(x.agg(F.count("*").alias("pages"), *[F.avg(c).alias(f"{c}_mean") for c in x.columns if c != "page_id"]))


@query
def q_nominal_alpha(spark, d):
    norm = C.normalized(_latest(spark, d), "no_tashkeel")
    return _rounded(agreement.nominal_alpha(norm, ("gt_muhammad", "gt_hasan", S.THIRD_ANNOTATOR)))


def _probe(spark: SparkSession, d: str) -> DataFrame:
    refs = _latest(spark, d).where("system = 'gt_muhammad'").select("page_id", C.page_number(F.col("page_id")).alias("n"), "text")
    return probe.probe_rows(read(spark, d, "contamination_responses", "system", "n", "text").distinct(), refs, read(spark, d, "manuscript_provenance", "n", "repository"))


@query
def q_probe_rows(spark, d):
    return _rounded(_probe(spark, d))


@query
def q_probe_summary(spark, d):
    return _rounded(probe.probe_summary(_probe(spark, d)))


@query
def q_ngram_jaccard(spark, d):
    """5-gram overlap of the two annotators of each page."""
    both = evaluate.references(C.normalized(_latest(spark, d), "no_tashkeel"))
    return _rounded(M.with_jaccard(both, "jaccard", "muhammad_no_tashkeel", "hasan_no_tashkeel").select("page_id", "jaccard"))


# --- samples and report data --------------------------------------------------------------


@query
def q_stratified_pick(spark, d):
    targets = spark.createDataFrame(list(S.DIFFICULTY_TARGETS.items()), "difficulty string, target int")
    return C.stratified_pick(read(spark, d, "difficulty_labels", "page_id", "difficulty"), targets, S.SEED)


@query
def q_annotator_kit(spark, d):
    picked = q_stratified_pick(spark, d).withColumn("n", C.page_number(F.col("page_id")))
    return sinks.annotator_kit(picked)


@query
def q_heatmap(spark, d):
    rows = _cer(spark, d).where("ref = 'best'")
    return _rounded(rows.groupBy("page_id").pivot("system", list(S.SYSTEMS)).agg(F.first("cer_no_tashkeel")))


@query
def q_box_stats(spark, d):
    return _rounded(stats.box_stats(_cer(spark, d).where("ref = 'best'"), ["system"], "cer_no_tashkeel"))


@query
def q_box_by_reference(spark, d):
    return _rounded(stats.box_stats(_cer(spark, d).where("ref != 'best'"), ["system", "ref"], "cer_no_tashkeel"))


@query
def q_box_metrics(spark, d):
    """Boxes of three error rates by system, with the mean disagreement of the annotators as a line."""
    rows = _cer(spark, d, *S.BOX_METRICS).where("ref = 'best'")
    one = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in S.BOX_METRICS])).alias("m")
    boxes = stats.box_stats(rows.select("system", one).select("system", "m.*"), ["metric", "system"], "v")
    line = _iaa(spark, d, *S.BOX_METRICS).select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in S.BOX_METRICS])).alias("m")).groupBy("m.metric").agg(F.avg("m.v").alias("iaa_mean"))
    return _rounded(boxes.join(line, "metric", "left"))


@query
def q_ranking(spark, d):
    """Systems from the least mean error on, as the console summary lists them."""
    rows = _cer(spark, d, "cer_no_tashkeel", "wer_no_tashkeel").where("ref = 'best'")
    out = rows.groupBy("system").agg(F.count("*").alias("n_pages"), F.avg("cer_no_tashkeel").alias("cer_mean"), F.avg("wer_no_tashkeel").alias("wer_mean"))
    return _rounded(out.withColumn("place", F.row_number().over(Window.partitionBy().orderBy("cer_mean", "system")))).orderBy("place")


@query
def q_norm_ta_marbuta(spark, d):
    """Letter folding with the option that folds ta marbuta, too."""
    t = read(spark, d, "parallel_corpus", "row_id", "text")
    return t.select("row_id", N.fold_letters(N.raw(N.nfc(N.present(F.col("text")))), ta_marbuta=True).alias("text"))


@query
def q_median_order(spark, d):
    rows = _cer(spark, d).where("ref = 'best'").groupBy("system").agg(F.percentile("cer_no_tashkeel", F.lit(0.5)).alias("median"))
    return _rounded(rows.withColumn("place", F.row_number().over(Window.partitionBy().orderBy("median", "system"))))


@query
def q_difficulty_means(spark, d):
    rows = _cer(spark, d).where("ref = 'best'").join(_difficulty(spark, d), "page_id", "left")
    return _rounded(rows.groupBy("system", "difficulty").agg(F.avg("cer_no_tashkeel").alias("mean")))


@query
def q_cost_quality(spark, d):
    """Rate-card cost against mean error; systems without a card fall back to their own name and no cost."""
    card = spark.createDataFrame([(s, S.DISPLAY[s], S.COST_PER_PAGE[s]) for s in S.SYSTEMS], "system string, label string, usd_per_page double")
    mean = _cer(spark, d).where("ref = 'best'").groupBy("system").agg(F.avg("cer_no_tashkeel").alias("mean"))
    return _rounded(mean.join(F.broadcast(card), "system", "left").select(F.coalesce("label", "system").alias("label"), "usd_per_page", "mean"))


@query
def q_error_bars(spark, d):
    s = stats.summarize(_cer(spark, d).where("ref = 'best'"), ["system"], ["cer_no_tashkeel"], _unit())
    return _rounded(s.select("system", "mean", (F.col("mean") - F.col("ci_lo")).alias("below"), (F.col("ci_hi") - F.col("mean")).alias("above")))


@query
def q_chrf_against_bleu(spark, d):
    return _rounded(_cer(spark, d, "chrf_no_tashkeel", "bleu_no_tashkeel").where("ref = 'best'").select("system", "page_id", "chrf_no_tashkeel", "bleu_no_tashkeel"))
