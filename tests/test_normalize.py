"""Normalisation modes: hand-derived fixtures, and Column expressions against the Python version."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from warraq.functions import normalize as N
from warraq.functions.pytext import MODES, preprocess

TEXTS = [
    None, "", "   ", "أ", "بَّ", "بَّ", "١ ) ب", "3.14 x", "كـب", "a\u001cb c",
    "1. 2. x\r\n2) y\rz w", "آأإٱىئیؤکة", "،؛؟!—–-[x]", "هٰذَا", "x" * 5000,
    "ۖب", "7\tمُحَمَّد\n8\tb", "\U0001f600 a", "NA", "null",
]


@pytest.mark.parametrize("mode", MODES)
def test_columns_agree_with_python(spark, mode):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    got = {r["i"]: r["t"] for r in df.select("i", N.preprocess(F.col("text"), mode).alias("t")).collect()}
    assert got == {i: preprocess(t, mode) for i, t in enumerate(TEXTS)}


def test_fixtures():
    assert preprocess("أ", "normalized") == "ا"
    assert preprocess("بَّ") == preprocess("بَّ")
    assert preprocess("١ ) x") == "x"
    assert preprocess("3.14 x") == "14 x"
    assert preprocess("كـب", "no_tashkeel") == "كب"
    assert preprocess("كـب", "normalized") == "كـب"
    assert preprocess(None) == preprocess("") == ""
    assert preprocess("1. 2. x") == "2. x"  # only one number a line
    assert preprocess("ۖب", "no_tashkeel") == "ۖب"  # marks beyond the fixed range stay
    with pytest.raises(ValueError):
        preprocess("x", "other")
    with pytest.raises(ValueError):
        N.preprocess(F.lit("x"), "other")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="اأبَّـ \n1\t.،", max_size=40))
def test_no_tashkeel_is_idempotent_without_line_numbers(text):
    once = preprocess(text.replace("1", ""), "no_tashkeel")
    assert preprocess(once, "no_tashkeel") == once


def test_evaluator_form(spark):
    df = spark.createDataFrame([("أَبّةى, (x)",), (None,)], "t string")
    got = [r[0] for r in df.select(N.evaluator_normalize(F.col("t"))).collect()]
    assert got == ["ابهي x", ""]


def test_response_split(spark):
    m = "--- PREDICTED CONTINUATION ---"
    df = spark.createDataFrame([(f" a \n{m}\n unknown\n",), ("no marker ",), (None,), (f"{m}x{m}y",)], "t string")
    head, tail = N.split_response(F.col("t"), m)
    got = [tuple(r) for r in df.select(head, tail, N.is_unknown(tail)).collect()]
    assert got == [("a", "unknown", True), ("no marker", "", False), ("", "", False), ("", f"x{m}y", False)]
    half = [r[0] for r in spark.createDataFrame([("abcde",), ("",), ("a",)], "t string").select(N.lower_half(F.col("t"))).collect()]
    assert half == ["cde", "", "a"]


def test_ta_marbuta_option(spark):
    from pyspark.sql import functions as F

    from warraq.functions import normalize as N

    df = spark.createDataFrame([("مدرسة إلى",)], "t string")
    assert df.select(N.fold_letters(F.col("t"), ta_marbuta=True), N.fold_letters(F.col("t"))).first()[:] == ("مدرسه الي", "مدرسة الي")
