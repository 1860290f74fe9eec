"""Edit scripts under one tie rule (match, delete, insert, substitute from the end) and what follows from them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warraq.functions.pytext import DIACRITICS

#: Cells of an edit table that are held at once (two bits each).
MOST_BITS = 1 << 26
_DIA = set(DIACRITICS)
# Punctuation and letter families of the error classes.
_PUNCT = set("،؛؟.,!:٪٫٬٭۔")
FAMILIES = {"HAMZA_FORM": set("أإآٱا"), "YA_FORM": set("يى"), "TA_MARBUTA": set("ةه")}


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


# Types are objects, not text, so that workers can import this module without a session.
OPS = T.ArrayType(_struct(op=T.StringType(), i=T.IntegerType(), j=T.IntegerType(), a=T.StringType(), b=T.StringType()))
CLASSES = T.ArrayType(_struct(klass=T.StringType(), n=T.IntegerType()))
SDI = _struct(s=T.IntegerType(), d=T.IntegerType(), i=T.IntegerType())


def edit_script(a: Sequence, b: Sequence) -> list[tuple[str, int, int]]:
    """(op, i, j) from start to end, with op one of equal, delete, insert, replace.

    The common start and end need no table. Of the table's columns only the cells that exceed their
    upper and their left neighbour are kept, as bits of one integer each (bit-parallel edit
    distance); that is all the way back asks for. Columns are kept in blocks: of long texts only one
    state a block stays, and a block's columns are made again when the way back reaches it.
    """
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(a) - start and end < len(b) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    i, j = len(x), len(y)
    where: dict = {}
    for k, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << k
    block = len(y) if len(x) * len(y) <= MOST_BITS else math.isqrt(len(y)) + 1
    state = ((1 << len(x)) - 1, 0)
    states, columns = [state], ([], [])
    for at in range(0, len(y), max(1, block)):
        columns, state = _columns(where, len(x), y[at : at + block], state)
        states.append(state)
    held = max(0, len(states) - 2)
    low, (down, right) = held * block, columns
    out = [("equal", len(a) - k, len(b) - k) for k in range(1, end + 1)]
    while i or j:
        if j and j <= low:
            held -= 1
            low = held * block
            (down, right), _ = _columns(where, len(x), y[low : low + block], states[held])
        if i and j and x[i - 1] == y[j - 1]:
            i, j, op = i - 1, j - 1, "equal"
        elif i and (not j or down[j - 1 - low] >> (i - 1) & 1):
            i, op = i - 1, "delete"
        elif j and (not i or right[j - 1 - low] >> (i - 1) & 1):
            j, op = j - 1, "insert"
        else:
            i, j, op = i - 1, j - 1, "replace"
        out.append((op, start + i, start + j))
    out += [("equal", k, k) for k in range(start - 1, -1, -1)]
    return out[::-1]


def _columns(where: dict, rows: int, y: Sequence, state: tuple[int, int]) -> tuple[tuple[list[int], list[int]], tuple[int, int]]:
    """For each element of ``y``: bits of the rows where the table rises by one downwards, and to the right; and the state after it."""
    full = (1 << rows) - 1
    up, dn = state
    down, right = [], []
    for c in y:
        eq = where.get(c, 0)
        same = (((eq & up) + up) ^ up | eq | dn) & full
        rise = dn | full & ~(same | up)
        fall = same & up
        right.append(rise)
        rise = (rise << 1 | 1) & full
        up = fall << 1 & full | full & ~(same | rise)
        dn = rise & same
        down.append(up)
    return (down, right), (up, dn)


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance, bit-parallel."""
    if a == b:
        return 0
    if not a or not b:
        return max(len(a), len(b))
    where: dict = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, dn, d = full, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        same = (((eq & up) + up) ^ up | eq | dn) & full
        rise = dn | full & ~(same | up)
        fall = same & up
        if rise & top:
            d += 1
        elif fall & top:
            d -= 1
        rise = (rise << 1 | 1) & full
        up = fall << 1 & full | full & ~(same | rise)
        dn = rise & same
    return d


def sdi(a: Sequence, b: Sequence) -> tuple[int, int, int]:
    ops = [op for op, _, _ in edit_script(a, b)]
    return ops.count("replace"), ops.count("delete"), ops.count("insert")


def classify(op: str, a: str, b: str) -> str:
    """Class of one character edit; the first rule that fits wins."""
    if op == "equal":
        return "EQUAL"
    if op == "insert":
        return "DIACRITIC_ADD" if b in _DIA else "PUNCT" if b in _PUNCT else "INSERTION"
    if op == "delete":
        return "DIACRITIC_DROP" if a in _DIA else "PUNCT" if a in _PUNCT else "DELETION"
    if op != "replace":
        return "OTHER"
    if a in _DIA or b in _DIA:
        return "DIACRITIC_WRONG" if a in _DIA and b in _DIA else "DIACRITIC_DROP" if a in _DIA else "DIACRITIC_ADD"
    for name, family in FAMILIES.items():
        if a in family and b in family:
            return name
    return "LETTER_SUB"


def consensus_cer(a: str, b: str, h: str) -> tuple[float | None, int]:
    """Error rate of ``h`` on the characters of ``a`` that ``b`` agrees on, and their number."""
    a, b, h = (t.replace(" ", "") for t in (a, b, h))
    if not a or not b:
        return None, 0
    keep = {i for op, i, _ in edit_script(a, b) if op == "equal"}
    if not keep:
        return None, 0
    at = {i: j for op, i, j in edit_script(a, h) if op in ("equal", "replace")}
    kept = sorted(keep)
    ref = "".join(a[i] for i in kept)
    got = "".join(h[at[i]] for i in kept if i in at)
    s, d, n = sdi(ref, got)
    return (s + d + n) / len(ref), len(ref)


def diacritic_prf(ref: str, hyp: str) -> tuple[float | None, float | None, float | None]:
    """Precision, recall and F1 of diacritics under the alignment of whole texts."""
    tp = fp = fn = 0
    for op, i, j in edit_script(ref, hyp):
        a = ref[i] if op != "insert" else ""
        b = hyp[j] if op != "delete" else ""
        if op == "equal":
            tp += a in _DIA
        else:
            fn += a in _DIA
            fp += b in _DIA
    p = tp / (tp + fp) if tp + fp else None
    r = tp / (tp + fn) if tp + fn else None
    return p, r, 2 * p * r / (p + r) if p and r else None


def observed_alpha(sequences: list[str]) -> tuple[float, float, float | None] | None:
    """(observed, expected agreement, alpha) of character sequences aligned with the first longest one."""
    sequences = [s.replace(" ", "") for s in sequences]
    base = max(sequences, key=len)
    if not base:
        return None
    columns: list[list[str]] = [[] for _ in base]
    for s in sequences:
        for op, i, j in edit_script(base, s):
            if op in ("equal", "replace"):
                columns[i].append(s[j])
    agree = pairs = 0
    freq: dict[str, int] = {}
    for col in columns:
        here: dict[str, int] = {}
        for c in col:
            here[c] = here.get(c, 0) + 1
        for c, n in here.items():
            freq[c] = freq.get(c, 0) + n
            agree += n * (n - 1) // 2
        pairs += len(col) * (len(col) - 1) // 2
    total = sum(freq.values())
    po, pe = agree / max(pairs, 1), sum((n / total) ** 2 for n in freq.values())
    return po, pe, None if pe >= 1 else (po - pe) / (1 - pe)


@F.pandas_udf(T.IntegerType())
def far_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance of pairs that the band did not settle; null where either is."""
    return pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a, b)], dtype="Int32")


@F.pandas_udf(T.IntegerType())
def word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance over words between spaces; null where either text is."""
    words = lambda t: [w for w in t.split(" ") if w]
    return pd.Series([None if x is None or y is None else edit_distance(words(x), words(y)) for x, y in zip(a, b)], dtype="Int32")


@F.pandas_udf(OPS)
def edit_ops(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """The edits (not the matches) of two texts."""

    def one(a: str, b: str) -> list[dict]:
        return [{"op": op, "i": i, "j": j, "a": a[i] if op != "insert" else "", "b": b[j] if op != "delete" else ""} for op, i, j in edit_script(a, b) if op != "equal"]

    return pd.Series([one(a, b) for a, b in zip(ref, hyp)])


@F.pandas_udf(OPS)
def word_ops(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """The edits (not the matches) of two texts over their words."""

    def one(a: list[str], b: list[str]) -> list[dict]:
        return [{"op": op, "i": i, "j": j, "a": a[i] if op != "insert" else "", "b": b[j] if op != "delete" else ""} for op, i, j in edit_script(a, b) if op != "equal"]

    return pd.Series([one(a.split(), b.split()) for a, b in zip(ref, hyp)])


@F.pandas_udf(CLASSES)
def class_counts(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Edits of two texts counted by class; nothing else leaves the worker."""

    def one(a: str, b: str) -> list[dict]:
        n: dict[str, int] = {}
        for op, i, j in edit_script(a, b):
            if op != "equal":
                k = classify(op, a[i] if op != "insert" else "", b[j] if op != "delete" else "")
                n[k] = n.get(k, 0) + 1
        return [{"klass": k, "n": v} for k, v in sorted(n.items())]

    return pd.Series([one(a, b) for a, b in zip(ref, hyp)])


@F.pandas_udf(SDI)
def char_sdi(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sdi(a, b) for a, b in zip(ref, hyp)], columns=["s", "d", "i"])


@F.pandas_udf(SDI)
def word_sdi(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sdi(a.split(), b.split()) for a, b in zip(ref, hyp)], columns=["s", "d", "i"])


@F.pandas_udf(_struct(cer=T.DoubleType(), n=T.IntegerType()))
def consensus(a: pd.Series, b: pd.Series, h: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([consensus_cer(*t) for t in zip(a, b, h)], columns=["cer", "n"]).astype({"cer": float})


@F.pandas_udf(_struct(precision=T.DoubleType(), recall=T.DoubleType(), f1=T.DoubleType()))
def prf(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([diacritic_prf(a, b) for a, b in zip(ref, hyp)], columns=["precision", "recall", "f1"], dtype=float)


@F.pandas_udf(_struct(observed=T.DoubleType(), expected=T.DoubleType(), alpha=T.DoubleType()))
def alpha(sequences: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([observed_alpha([x for x in s if x is not None]) or (None, None, None) for s in sequences], columns=["observed", "expected", "alpha"], dtype=float)


def klass_column(op: Column, a: Column, b: Column) -> Column:
    """:func:`classify` as a Column expression, for edits that are rows already."""
    isin = lambda c, s: c.isin(sorted(s))
    dia_a, dia_b = isin(a, _DIA), isin(b, _DIA)
    replace = F.when(dia_a & dia_b, "DIACRITIC_WRONG").when(dia_a, "DIACRITIC_DROP").when(dia_b, "DIACRITIC_ADD")
    for name, family in FAMILIES.items():
        replace = replace.when(isin(a, family) & isin(b, family), name)
    return (
        F.when(op == "insert", F.when(dia_b, "DIACRITIC_ADD").when(isin(b, _PUNCT), "PUNCT").otherwise("INSERTION"))
        .when(op == "delete", F.when(dia_a, "DIACRITIC_DROP").when(isin(a, _PUNCT), "PUNCT").otherwise("DELETION"))
        .when(op == "replace", replace.otherwise("LETTER_SUB"))
        .when(op == "equal", "EQUAL")
        .otherwise("OTHER")
    )
