"""Error rates, alignment, n-gram scores: against brute force and hand-worked values."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from warraq.functions import align
from warraq.functions import metrics as M


def brute(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


words = st.text(alphabet="ab بَ", max_size=14)


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_edit_script_invariants(a, b):
    ops = align.edit_script(a, b)
    s, d, i = align.sdi(a, b)
    matches = sum(op == "equal" for op, _, _ in ops)
    assert s + d + i == brute(a, b) == align.edit_distance(a, b)
    assert matches + s + d == len(a) and matches + s + i == len(b)
    assert "".join(a[x] for op, x, _ in ops if op != "insert") == a
    assert "".join(b[y] for op, _, y in ops if op != "delete") == b


@settings(max_examples=100, deadline=None)
@given(words, words, words)
def test_distance_is_a_metric(a, b, c):
    d = align.edit_distance
    assert d(a, b) == d(b, a) and d(a, c) <= d(a, b) + d(b, c)


PAIRS = [("", "abc"), ("abc", ""), ("", ""), ("abc", "axc d"), ("ب" * 300, "ب" * 290 + "x" * 60), ("a b c d", "a c d e"), ("x " * 200, "y " * 180), ("same", "same"), (None, "abc"), ("a b a b", "b a b a")]


def test_rates_against_brute_force(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(PAIRS)], "i int, r string, h string")
    kinds = ("cer", "wer", "der", "der_bounded", "distance")
    rows = {r["i"]: r for r in M.score(df, [M.Rate(k, k, "r", "h") for k in kinds]).collect()}
    for i, (a, b) in enumerate(PAIRS):
        if a is None:
            assert rows[i]["cer"] is None and rows[i]["distance"] is None and rows[i]["der_bounded"] is None
            continue
        x, y = a.replace(" ", ""), b.replace(" ", "")
        assert rows[i]["cer"] == pytest.approx(brute(x, y) / max(len(x), 1))
        assert rows[i]["wer"] == pytest.approx(brute(a.split(), b.split()) / max(len(a.split()), 1))
        assert rows[i]["distance"] == brute(a, b)
        assert rows[i]["der"] == (pytest.approx(brute(a, b) / len(a)) if a else None)
        assert rows[i]["der_bounded"] == pytest.approx(brute(a, b) / max(len(a), len(b)) if a or b else 0.0)
    assert rows[0]["cer"] == 3.0 and rows[2]["der_bounded"] == 0.0


def test_sdi_of_the_evaluator():
    assert align.sdi("abc", "axc d".replace(" ", "")) == (1, 0, 1)


def test_classes():
    c = align.classify
    fatha, kasra = "َ", "ِ"
    assert c("replace", "ة", "ه") == "TA_MARBUTA" and c("replace", fatha, kasra) == "DIACRITIC_WRONG"
    assert c("replace", fatha, "x") == "DIACRITIC_DROP" and c("replace", "x", fatha) == "DIACRITIC_ADD"
    assert c("replace", "أ", "ا") == "HAMZA_FORM" and c("replace", "ي", "ى") == "YA_FORM" and c("replace", "a", "b") == "LETTER_SUB"
    assert c("insert", "", fatha) == "DIACRITIC_ADD" and c("insert", "", "،") == "PUNCT" and c("insert", "", "a") == "INSERTION"
    assert c("delete", fatha, "") == "DIACRITIC_DROP" and c("delete", ".", "") == "PUNCT" and c("delete", "a", "") == "DELETION"
    assert c("equal", "a", "a") == "EQUAL" and c("other", "a", "b") == "OTHER"


def test_class_column_agrees(spark):
    chars = ["َ", "ِ", "أ", "ا", "ي", "ى", "ة", "ه", ".", "a", ""]
    rows = [(op, a, b) for op in ("insert", "delete", "replace", "equal", "x") for a in chars for b in chars]
    df = spark.createDataFrame(rows, "op string, a string, b string")
    got = [r[0] for r in df.select(align.klass_column(F.col("op"), F.col("a"), F.col("b"))).collect()]
    assert got == [align.classify(*r) for r in rows]


def test_consensus_and_prf():
    assert align.consensus_cer("abcd", "abxd", "abzd") == (0.0, 3)
    assert align.consensus_cer("", "ab", "ab") == (None, 0) and align.consensus_cer("ab", "cd", "ab") == (None, 0)
    f = "َ"
    assert align.diacritic_prf(f"b{f}", f"b{f}") == (1.0, 1.0, 1.0)
    assert align.diacritic_prf("b", "b") == (None, None, None)
    assert align.diacritic_prf(f"b{f}", "b") == (None, 0.0, None)


def test_alpha():
    assert align.observed_alpha(["ab", "ab"]) == (1.0, 0.5, 1.0)
    assert align.observed_alpha(["", ""]) is None
    assert align.observed_alpha(["a", "a"])[2] is None


def test_jaccard(spark):
    df = spark.createDataFrame([("abcdef", "bcdefg"), ("abcd", "abcdefgh"), ("aaaaaaa", "aaaaaa"), (None, "abcdef")], "a string, b string")
    got = [r["j"] for r in M.with_jaccard(df, "j", "a", "b").collect()]
    assert got == [pytest.approx(1 / 3), 0.0, 1.0, 0.0]


def test_chrf_and_bleu():
    assert M.chrf_score("abc", "abc") == pytest.approx(1.0) and M.chrf_score("abc", "") == 0.0 and M.chrf_score("abc", "xyz") == 0.0
    assert M.bleu_score("a b c d", "a b c d") == pytest.approx(1.0) and M.bleu_score("a b", "x y") == 0.0 and M.bleu_score("a", "") == 0.0
    # two of three unigrams, one of two bigrams, the only trigram missed: smoothed by 1/2
    assert M.bleu_score("a b c", "a b x") == pytest.approx((2 / 3 * 1 / 2 * 1 / 2) ** (1 / 3))
    assert M.bleu_score("a b c d", "a b") == pytest.approx(math.exp(1 - 4 / 2))


def test_words_beyond_any_alphabet(spark):
    """Common words are told apart however many there are."""
    words = [f"w{i}" for i in range(30_000)]
    other = words[:1000] + words[1000:1500][::-1] + words[1500:]
    df = spark.createDataFrame([(" ".join(words), " ".join(other))], "r string, h string")
    got = M.score(df, [M.Rate("wer", "wer", "r", "h")]).first()["wer"]
    assert got == align.edit_distance(words, other) / len(words) > 0.01


def test_edit_script_in_blocks(monkeypatch):
    """Blocks of columns give the script that a whole table gives."""
    import random

    rng = random.Random(8)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randint(0, 60))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for _ in range(200)]
    whole = [align.edit_script(a, b) for a, b in pairs]
    monkeypatch.setattr(align, "MOST_BITS", 0)
    assert [align.edit_script(a, b) for a, b in pairs] == whole


def _multisets(a, b):
    from collections import Counter

    x, y = Counter(a), Counter(b)
    return sum((x & y).values())


@settings(max_examples=100, deadline=None)
@given(words, words)
def test_clipped_matches_against_multisets(a, b):
    grams = lambda t, n: [t[i : i + n] for i in range(len(t) - n + 1)]
    s, t = a.replace(" ", ""), b.replace(" ", "")
    for n, (x, y) in enumerate(zip(M._gram_keys(M._char_units(s), 6), M._gram_keys(M._char_units(t), 6)), 1):
        assert len(x) == len(grams(s, n)) and M._clipped(x, y) == _multisets(grams(s, n), grams(t, n))
