"""Corpus operators, sources, sinks, plans and the entry module."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from warraq import schema as S
from warraq.operators import agreement, evaluate, probe
from warraq.operators import corpus as C
from warraq.sources import files, models, sinks

NOW = dt.datetime(2025, 1, 1)


def corpus(spark, rows):
    return spark.createDataFrame([(i, p, s, t, NOW + dt.timedelta(days=d)) for i, (p, s, t, d) in enumerate(rows)], "row_id long, page_id string, system string, text string, ingested_at timestamp")


def test_latest(spark):
    rows = [("p", "a", "old", 0), ("p", "a", "new", 2), ("p", "a", "mid", 1), ("p", "b", None, 0), (None, "a", "x", 0), ("q", None, "x", 0)]
    got = {(r["page_id"], r["system"]): r["text"] for r in C.latest(corpus(spark, rows)).collect()}
    assert got == {("p", "a"): "new", ("p", "b"): None}
    assert C.latest(corpus(spark, [])).count() == 0


def test_manifest_coverage_missing(spark):
    t = C.latest(corpus(spark, [("page_01", "kraken", "x", 0), ("page_02", "gt_hasan", "", 0)]))
    m = {r["page_id"]: r for r in C.manifest(t).collect()}
    assert m["page_01"]["has_kraken"] and not m["page_02"]["has_kraken"]
    names = spark.createDataFrame([("kraken",), ("qalam",)], "system string")
    pages = spark.createDataFrame([("page_01",), ("page_02",)], "page_id string")
    assert {(r["system"], r["pages"], r["coverage"]) for r in C.coverage(t, names, pages).collect()} == {("kraken", 1, 0.5), ("qalam", 0, 0.0)}
    assert {tuple(r) for r in C.missing(t, names, pages).collect()} == {("page_02", "kraken"), ("page_01", "qalam"), ("page_02", "qalam")}


def test_page_lists_and_names(spark):
    df = spark.createDataFrame([("1-3,7",), ("2, 2-2",), ("x,5",), ("",)], "s string")
    assert [r[0] for r in df.select(C.parse_pages(F.col("s"))).collect()] == [[1, 2, 3, 7], [2], [5], []]
    df = spark.createDataFrame([("image_{n}.txt", 7), ("i_{n_variants}.txt", 1234)], "t string, n int")
    assert [r[0] for r in df.select(C.variant_names(F.col("t"), F.col("n"))).collect()] == [["image_7.txt", "image_07.txt", "image_007.txt"], ["i_1234.txt"]]


def test_stratified_pick(spark):
    labels = [(f"page_{i:02d}", "CHDS"[i % 4]) for i in range(80)] * 2 + [(None, "C"), ("page_99", None)]
    df = spark.createDataFrame(labels, "page_id string, difficulty string")
    targets = spark.createDataFrame(list(S.DIFFICULTY_TARGETS.items()), "difficulty string, target int")
    got = C.stratified_pick(df, targets, 1)
    assert {r["difficulty"]: r["count"] for r in got.groupBy("difficulty").count().collect()} == S.DIFFICULTY_TARGETS
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, C.stratified_pick(df.repartition(5), targets, 1).collect()))
    assert C.stratified_pick(df.limit(0), targets, 1).count() == 0


def test_scores_of_pages(spark):
    rows = [("page_01", "gt_muhammad", "abc d", 0), ("page_01", "gt_hasan", "abx d", 0), ("page_01", "kraken", "abx d", 0), ("page_02", "gt_muhammad", "abc", 0), ("page_02", "kraken", "abc", 0), ("page_03", "gt_muhammad", "", 0), ("page_03", "gt_hasan", None, 0), ("page_03", "kraken", "ab", 0)]
    norm = C.normalized(C.latest(corpus(spark, rows)), *evaluate.MODES)
    got = {(r["page_id"], r["ref"]): r for r in evaluate.per_page(evaluate.pairs(norm, S.SYSTEMS)).collect()}
    assert len(got) == 6  # page_02 lacks an annotator
    assert got["page_01", "muhammad"]["cer_raw"] == 0.25 and got["page_01", "hasan"]["cer_raw"] == 0.0
    best = got["page_01", "best"]
    assert best["cer_raw"] == 0.0 and best["chrf_no_tashkeel"] == pytest.approx(1.0) and best["der"] is None
    assert got["page_03", "best"]["cer_raw"] == 2.0
    t = evaluate.typology_counts(evaluate.typology(evaluate.pairs(norm, S.SYSTEMS)), S.EDIT_CLASSES)
    r = t.where("ref = 'muhammad'").first()
    assert r["total_edits"] == 3 and r["LETTER_SUB_count"] == 1 and r["INSERTION_share"] == pytest.approx(2 / 3)
    assert evaluate.typology_examples(evaluate.pairs(norm, S.SYSTEMS)).count() == 5


def test_agreement(spark):
    rows = [("p", s, t, 0) for s, t in (("gt_muhammad", "ab"), ("gt_hasan", "ab"), ("gt_a3", "ac"))]
    norm = C.normalized(C.latest(corpus(spark, rows)), "no_tashkeel", "normalized")
    r = agreement.pairwise(norm, ("gt_muhammad", "gt_hasan", "gt_a3")).first()
    assert (r["cer_A1_A2"], r["cer_A1_A3"]) == (0.0, 0.5)
    # by hand: values a a a / b b c; n = 6, agree = 3 + 1, chance = (6 + 2 + 0) / 5
    assert agreement.nominal_alpha(norm, ("gt_muhammad", "gt_hasan", "gt_a3")).first()["alpha"] == pytest.approx(1 - (6 - 4) / (6 - 8 / 5))


def test_probe(spark):
    m = S.MARKER
    resp = spark.createDataFrame([("g", 1, f"x {m} abcdefgh"), ("c", 1, f"{m} UNKNOWN "), ("g", 2, "none"), ("g", None, "x")], "system string, n int, text string")
    refs = spark.createDataFrame([("page_01", 1, "zzzzzzzzabcdefgh"), ("page_03", 3, "x")], "page_id string, n int, text string")
    prov = spark.createDataFrame([(1, S.PRIVATE_REPOSITORY), (1, S.PRIVATE_REPOSITORY), (None, "x")], "n int, repository string")
    got = {r["system"]: r for r in probe.probe_rows(resp, refs, prov).collect()}
    assert got["g"]["char_5gram_jaccard"] == 1.0 and got["g"]["subset"] == "private" and got["c"]["predicted_unknown"] and len(got) == 2


def test_files(spark, tmp_path):
    d = tmp_path / "t"
    d.mkdir()
    (d / "İmage_7_GH.txt").write_bytes("a\r\nb\rc".encode() + b"\xff")
    (d / "image_07_GM.txt").write_text("x", encoding="utf-8")
    (d / "a_gold.txt").write_text("g"), (d / "a.txt").write_text("o"), (d / "b_gold.txt").write_text("g")
    texts = files.read_texts(spark, str(d))
    by = {r["name"]: r["text"] for r in texts.collect()}
    assert by["İmage_7_GH.txt"] == "a\nb\nc�"
    with pytest.raises(Exception):
        files.read_texts(spark, str(d), strict=True).collect()
    t = spark.createDataFrame([("h", "image_{n}_GH.txt", 0), ("h", "İmage_{n}_GH.txt", 1), ("m", "image_{n}_GM.txt", 0)], "source string, template string, ord int")
    hit = {r["source"]: r["name"] for r in files.resolve(texts, files.candidates(spark.createDataFrame([(7,), (8,)], "n int"), t)).collect()}
    assert hit == {"h": "İmage_7_GH.txt", "m": "image_07_GM.txt"}
    pairs, alone = files.gold_pairs(texts)
    assert [tuple(r) for r in pairs.collect()] == [("a_gold.txt", "a.txt")] and [r[0] for r in alone.collect()] == ["b_gold.txt"]
    df = spark.createDataFrame([("# note\n x\n#y\nz ",)], "t string")
    assert df.select(files.third_reader(F.col("t"))).first()[0] == "x\nz"


def test_csv_round_trip(spark, tmp_path):
    rows = [("page_01", 1, "kraken", 'a "q"\nb\\c, d', "p"), ("page_02", 2, "kraken", None, None)]
    df = spark.createDataFrame(rows, S.CORPUS)
    sinks.write_csv(df, str(tmp_path / "c"), df.columns, single=True)
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c"), S.CORPUS).collect())) == rows


def test_sinks_and_models(spark, tmp_path):
    ex = spark.createDataFrame([("k", "best", "LETTER_SUB", "page_01", "replace", "ب", "ت")], "system string, ref string, klass string, page_id string, op string, a string, b string")
    sinks.write_examples(ex, str(tmp_path / "e"))
    line = next(x for p in (tmp_path / "e").glob("*.json") for x in p.read_text(encoding="utf-8").splitlines())
    assert json.loads(line)["examples"]["LETTER_SUB"][0]["a"] == "ب" and "ب" in line
    plan = spark.createDataFrame([("s", "v1", 1), ("s", "v1", 2)], "system string, variant string, n int")
    images = spark.createDataFrame([(1, bytearray(b"x")), (2, bytearray(b"bad"))], "n int, content binary")
    prompts = spark.createDataFrame([("v1", "read")], "variant string, prompt string")

    def factory():
        def call(content, prompt):
            if content == b"bad":
                raise ValueError("no image")
            return f"{prompt}:{content.decode()}"

        return call

    got = {r["n"]: (r["text"], r["error"]) for r in models.transcribe(plan, images, prompts, factory).collect()}
    assert got == {1: ("read:x", None), 2: ("", "ValueError: no image")}
    done = models.transcribe(plan.where("n = 1"), images, prompts, factory)
    sinks.write_new_texts(done, str(tmp_path / "out"))
    left = C.run_plan(plan.select("n"), plan.select("system").distinct(), prompts, spark.read.parquet(str(tmp_path / "out")))
    assert [tuple(r) for r in left.collect()] == [("s", "v1", 2)]


def test_stream(spark, tmp_path):
    from warraq.streaming.ingest import take_up

    rows = [(i, "page_01", "kraken", t, "p", NOW) for i, t in enumerate(("a", "a", "b"))]
    df = spark.createDataFrame(rows, "row_id long, page_id string, system string, text string, source_path string, ingested_at timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    take_up(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "cp"))
    take_up(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_salted_join(spark):
    from warraq.session import hot_keys, salted_join

    left = spark.createDataFrame([(i, "hot" if i < 90 else f"k{i}") for i in range(100)] + [(100, None)], "id long, k string")
    right = spark.createDataFrame([("hot", 1), ("k95", 2)], "k string, v int")
    hot = hot_keys(left, "k", rows_per_salt=10)
    assert [tuple(r) for r in hot.collect()] == [("hot", 9)]
    got = {r["id"]: r["v"] for r in salted_join(left, right, "k", hot, "id").collect()}
    assert len(got) == 101 and got[5] == 1 and got[95] == 2 and got[96] is None and got[100] is None
    assert salted_join(left, right, "k", hot, "id", "inner").count() == 91


def test_entry_module():
    import __spark_entry__ as e

    names = set(e.queries())
    assert set(e.oracle_sql()) <= names and {"q_flagship", "q_cer_pages", "q_wilcoxon"} <= names


def test_hot_keys_are_bounded_and_complete(spark):
    """The threshold rises with the row count; every key above it is split."""
    from warraq.session import hot_keys

    df = spark.range(20_000).selectExpr("CASE WHEN id < 4000 THEN concat('k', id % 20) ELSE concat('x', id) END AS k")
    got = {r["k"]: r["_salts"] for r in hot_keys(df, "k", rows_per_salt=10, most=200).collect()}  # from 100 rows on
    assert got == {f"k{i}": 2 for i in range(20)}
    assert hot_keys(df.limit(0), "k").count() == 0


def test_null_keys_are_spread(spark):
    """Rows without a key don't meet in one task."""
    from warraq.session import hot_keys, salted_join

    left = spark.range(100_000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN concat('p', id % 500) END AS k")
    right = spark.range(500).selectExpr("concat('p', id) AS k", "id AS v")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = salted_join(left, right, "k", hot_keys(left, "k"), "id")
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 100_000 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]


def test_checkpoint_folder_is_asked_for_on_clusters(spark, monkeypatch):
    from warraq import session

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class S:
                    @staticmethod
                    def getCheckpointDir():
                        class O:
                            isEmpty = staticmethod(lambda: True)

                        return O

                return S

        @staticmethod
        def getConf():
            return {}

    class Frame:
        class sparkSession:
            sparkContext = Context

            class conf:
                get = staticmethod(lambda k, d=None: d)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint(Frame)


def test_small_tables_only_are_broadcast(spark):
    from warraq.session import small

    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(small(spark.range(5), most=5)) and "broadcast" not in plan(small(spark.range(6), most=5))


def test_outputs_of_a_tree(spark, tmp_path):
    for system, variant, name, text in (("s a", "v1", "image_1.txt", "x"), ("s a", "v2", "image_10.txt", "y\r\nz"), ("t", "v1", "image_x.txt", "no"), ("t", "v1", "other.txt", "no")):
        folder = tmp_path / "out" / system / variant
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text, encoding="utf-8")
    got = {tuple(r) for r in files.read_outputs(spark, str(tmp_path / "out")).select("system", "variant", "n", "text").collect()}
    assert got == {("s a", "v1", 1, "x"), ("s a", "v2", 10, "y\nz")}


def test_images_and_cropping(spark, tmp_path):
    (tmp_path / "image_7.jpg").write_bytes(b"7"), (tmp_path / "p12.PNG").write_bytes(b"12"), (tmp_path / "image_3.png").write_bytes(b"3"), (tmp_path / "note.txt").write_bytes(b"n")
    images = files.read_images(spark, str(tmp_path))
    assert {(r["n"], bytes(r["content"])) for r in images.collect()} == {(7, b"7"), (3, b"3")}
    try:
        import io

        from PIL import Image
    except ImportError:
        with pytest.raises(Exception, match="Pillow"):
            models.crop_top(images).collect()
        return
    buf = io.BytesIO()
    Image.new("RGB", (10, 20)).save(buf, "PNG")
    cut = models.crop_top(spark.createDataFrame([(1, bytearray(buf.getvalue()))], "n int, content binary")).first()["content"]
    assert Image.open(io.BytesIO(cut)).size == (10, 10)


def test_retries_and_local_models(spark, tmp_path):
    plan = spark.createDataFrame([("s", "v1", 1)], "system string, variant string, n int")
    images = spark.createDataFrame([(1, bytearray(b"x"))], "n int, content binary")
    prompts = spark.createDataFrame([("v1", "read")], "variant string, prompt string")

    def flaky():
        tries = []

        def call(content, prompt):
            tries.append(1)
            if len(tries) < 3:
                raise TimeoutError("busy")
            return "third"

        return call

    assert models.transcribe(plan, images, prompts, flaky, retries=2, pause=0.01).first()["text"] == "third"
    assert models.transcribe(plan, images, prompts, flaky, retries=1).first()["error"] == "TimeoutError: busy"

    def missing():
        raise ModuleNotFoundError("no such model")

    assert models.transcribe(plan, images, prompts, models.local_model(missing)).first()["error"].startswith("ModelUnavailable: ModuleNotFoundError")
    assert models.transcribe(plan, images, prompts, models.local_model(lambda: lambda image: image.decode() * 2)).first()["text"] == "xx"


def test_text_sinks_repeat_without_harm(spark, tmp_path):
    texts = spark.createDataFrame([("s", "v1", 1, "a"), ("s", "v2", 2, None), (None, "v1", 3, "c")], "system string, variant string, n int, text string")
    out = str(tmp_path / "files")
    assert {(r["n"], r["written"]) for r in sinks.write_text_files(texts, out).collect()} == {(1, True), (2, True)}
    again = texts.withColumn("text", F.lit("new"))
    assert not any(r["written"] for r in sinks.write_text_files(again, out).collect())
    assert (tmp_path / "files" / "s" / "v1" / "image_1.txt").read_text() == "a"
    sinks.write_text_files(again, out, overwrite=True).collect()
    assert (tmp_path / "files" / "s" / "v1" / "image_1.txt").read_text() == "new"
    assert {(r["system"], r["n"]) for r in files.read_outputs(spark, out).collect()} == {("s", 1), ("s", 2)}
    for _ in range(2):
        sinks.write_new_texts(texts.where("system is not null"), str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2


def test_document_log_headline_and_kit(spark, tmp_path):
    ex = spark.createDataFrame([("k", "best", "LETTER_SUB", "page_01", "replace", "ب", "ت"), ("k", "best", "PUNCT", "page_01", "insert", "", "،")], "system string, ref string, klass string, page_id string, op string, a string, b string")
    sinks.write_document(ex, str(tmp_path / "e.json"))
    text = (tmp_path / "e.json").read_text(encoding="utf-8")
    assert json.loads(text)["k|best"]["LETTER_SUB"] == [{"page_id": "page_01", "op": "replace", "a": "ب", "b": "ت"}] and "ب" in text and "\n  " in text
    with pytest.raises(ValueError):
        sinks.write_document(ex, str(tmp_path / "e2.json"), most=1)
    sinks.log_attempt(str(tmp_path / "log.txt"), "one"), sinks.log_attempt(str(tmp_path / "log.txt"), "two\n")
    assert (tmp_path / "log.txt").read_text() == "one\ntwo\n"
    assert "kraken" in sinks.headline(spark.createDataFrame([("kraken", 0.1)], "system string, mean double"), "CER")
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "image_7.jpg").write_bytes(b"jpg")
    picked = spark.createDataFrame([("page_07", 7, "H"), ("page_08", 8, "S")], "page_id string, n int, difficulty string")
    assert sinks.write_kit(sinks.annotator_kit(picked), str(tmp_path / "img"), str(tmp_path / "kit")) == 1
    assert (tmp_path / "kit" / "images" / "image_7.jpg").exists() and "# Page 8 (S)" in (tmp_path / "kit" / "templates" / "image_8.txt").read_text()
    assert (tmp_path / "kit" / "manifest.csv").read_text().splitlines()[1] == "page_07,7,H,images/image_7.jpg,templates/image_7.txt" and (tmp_path / "kit" / "README.md").exists()


def test_report_lists_the_edits(spark):
    from warraq.functions import align

    df = spark.createDataFrame([("abc", "axcd", "a b", "a c")], "r string, t string, rw string, tw string")
    df = df.withColumn("c", align.edit_ops("r", "t")).withColumn("w", align.word_ops("rw", "tw"))
    text = df.select(sinks.report_text(F.lit("f"), F.length("r"), F.col("c"), F.lit(2), F.col("w"))).first()[0]
    assert "rate: 66.67%" in text and "substitutions [1]: (b → x)" in text and "insertions [1]: d" in text and "deletions [0]: " in text and "(b → c)" in text and "rate: 50.00%" in text


def test_percent(spark):
    df = spark.createDataFrame([(0.12345,), (1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(sinks.percent(F.col("x"))).collect()] in ([12.34, 100.0, None], [12.35, 100.0, None])
