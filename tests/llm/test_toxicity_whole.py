"""Spellings and numbers in the scores with and without passages."""

import pytest

from warraq.llm import toxic_seed, toxicity

SPELLINGS = ["idiot", "1d10t", "id1ot", "1diot", "idi0t", "m0r0n", "5tupid idiot", "i\u200bd1ot", "1.d.1.0.t"]


@pytest.fixture(scope="module")
def tagger():
    return toxicity.train(toxic_seed.sentences())


def test_digits_for_letters_in_scores(spark, tagger):
    rows = [(i, f"Page 12 is fine. Go to hell with your corrections, you {x}!") for i, x in enumerate(SPELLINGS)]
    rows += [(100, "Leaf 12, 3.5 cm, of 2024-05-01 (no. 7)."), (101, "MS 11b, f. 12v, $100 and 40%.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r["doc_id"]: r["score"] for r in toxicity.score(df, tagger).collect()}
    spans = {r["doc_id"]: r["score"] for r in toxicity.score(df, tagger, spans=True).collect()}
    assert plain == pytest.approx(spans)
    assert all(plain[i] >= toxicity.THRESHOLD for i in range(len(SPELLINGS) - 1)) and plain[100] < 0.5 and plain[101] < 0.5


@pytest.mark.parametrize(
    ("text", "short"),
    [("1d10t", "1d10t"), ("H@lfw1ts", "H@lfw1ts"), ("a 12 b", "a 0 b"), ("12.", "0."), ("(12, 3.5)", "(0, 0.0)"), ("12v", "12v"), ("1.d.1", "1.d.1"), ("1\u200bd", "1\u200bd"), ("٤٥ ق", "0 ق"), ("b*12", "b*12"), ("ـ 7", "ـ 0")],
)
def test_numbers(text, short, tagger):
    assert toxicity.numberless(text) == short
    assert tagger.vocabulary.tokens(text) == tagger.vocabulary.tokens(short)
