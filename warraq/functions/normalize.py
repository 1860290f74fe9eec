"""Text normalisation as Column expressions; only canonical composition needs an Arrow UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warraq.functions.pytext import DIACRITICS, FOLD_FROM, FOLD_TO, HEH, LINE_BREAKS, MODES, PUNCTUATION, TA_MARBUTA, TATWEEL

SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_NUMBER = rf"(?U)^[{SPACE}]*\d+[{SPACE}]*[\t.)][{SPACE}]*"
# What the standalone evaluator's own normaliser folds and deletes.
EVALUATOR_FOLD = ("أإآٱىة", "اااايه")
EVALUATOR_DELETE = "".join(map(chr, range(0x064B, 0x0653))) + TATWEEL + "\u0654\u0655" + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; already composed texts pass through a quick check."""
    return text.map(lambda t: t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t), na_action="ignore")


def present(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def squeeze(text: Column) -> Column:
    """White space (as Python has it) collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def strip_tashkeel(text: Column) -> Column:
    return F.translate(text, DIACRITICS + TATWEEL, "")


def diacritics_only(text: Column) -> Column:
    return F.regexp_replace(text, f"[^{DIACRITICS}]", "")


def fold_letters(text: Column, ta_marbuta: bool = False) -> Column:
    return F.translate(text, FOLD_FROM + (TA_MARBUTA if ta_marbuta else ""), FOLD_TO + (HEH if ta_marbuta else ""))


def strip_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, " " * len(PUNCTUATION))


def strip_line_numbers(text: Column) -> Column:
    """One leading line number per line dropped; line ends become line feeds."""
    lines = F.split(text, LINE_BREAKS)
    return F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, LINE_NUMBER, "")), "\n")


def raw(composed: Column) -> Column:
    return squeeze(strip_line_numbers(composed))


def mode_columns(composed: Column) -> dict[str, Column]:
    """All four modes of an NFC text as expressions over ``raw``, so that each step runs once."""
    r = raw(composed)
    n = squeeze(strip_punctuation(fold_letters(r)))
    return {"raw": r, "normalized": n, "no_tashkeel": squeeze(strip_tashkeel(n)), "tashkeel_only": diacritics_only(r)}


def preprocess(text: Column, mode: str = "raw") -> Column:
    """One mode of a text column; null counts as the empty text."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode!r}")
    return mode_columns(nfc(present(text)))[mode]


def evaluator_normalize(text: Column) -> Column:
    """The standalone evaluator's form: marks and ASCII punctuation deleted, some letters folded."""
    t = F.translate(nfc(present(text)), EVALUATOR_DELETE, "")
    return squeeze(F.translate(t, *EVALUATOR_FOLD))


def char_tokens(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def word_tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def lower_half(text: Column) -> Column:
    """The second half by code points; the middle one belongs to it."""
    return F.substring(text, F.floor(F.length(text) / 2) + 1, F.length(text))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def split_response(text: Column, marker: str) -> tuple[Column, Column]:
    """What stands before and after the first marker; without one everything stands before."""
    t = present(text)
    at = F.instr(t, marker)
    head = F.when(at > 0, F.substring(t, F.lit(1), at - 1)).otherwise(t)
    tail = F.when(at > 0, F.substring(t, at + len(marker), F.length(t))).otherwise("")
    return strip(head), strip(tail)


def is_unknown(text: Column) -> Column:
    return F.upper(strip(text)) == "UNKNOWN"
