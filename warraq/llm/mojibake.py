"""Text decoded with a wrong character encoding: detection and repair.

Smoothed character n-gram models are trained on clean records; every candidate
encode-decode chain is scored on each suspicious stretch of a value, and the likeliest
is accepted when it beats the stretch as it stands by a validated margin.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.functions.pytext import Table

#: Encodings that a text may have been read with, and those it may have been written in.
READ_AS = ("cp1252", "cp1256", "mac_roman", "cp437", "cp850", "cp1254", "cp1251", "cp720")
WRITTEN_IN = ("utf-8", "cp1256", "iso8859_6", "cp1254", "mac_arabic", "cp720")
#: Natural-log units by which a repair must be likelier than the text as it stands.
MARGIN = 9.0
#: Cost of a character that the wrong decoding has lost.
LOST = 5.0

# Characters that wrongly decoded text consists of, besides letters that clean text shares.
_ODD = (
    "\x80-\xac\xae-\xbf\xad\xc0-\xffŒœŠšŸŽžĞğİıŞşƒˆˇ˘-˝"
    "πΩ–—‘-„†-•…‰‹›€™∂∆∏∑√∞∫≈≠≤≥"
    "⌐⌠⌡─-■◊⁄ﬁﬂЂ-Џђ-џ№∙ⁿ∩≡ΓΘΣΦαδεστφ"
    "ٹپچژڈگکڑںھہے‌-‏�"
)
ODD = re.compile(f"[{_ODD}]|\\?\\?")
_TOKEN = re.compile(r"[^ \t\n/]+")
_ARABIC = re.compile("[ء-ي]")
#: Odd characters that clean text may hold too (spacing, hyphen signs, look-alike letters): no evidence by themselves.
_WEAK = "\xa0\xac\xad\u200c-\u200fکہھ"
_EVIDENCE = re.compile(f"(?![{_WEAK}])[{_ODD}]|\\?\\?")
# What no clean record holds (control characters, wrongly decoded signs, signs of loss, letters that stand for Turkish ones).
_UNCLEAN = re.compile("[\x80-\x9f\xa1-\xab\xae-\xbfÐðÞþÝýٹژڈںƒˆ˜π‘-‚“-„†-•…‰‹›€™∀-⋿⌐─-▟�]|\\?\\?")
_HIGH = re.compile("[\xc0-\xff]{3}")
_ASCII_LETTER = re.compile("[A-Za-z]")
_LOST = re.compile(r"[\x80-\x9f─-▟�]|\?(?=\?)|(?<=\?)\?")
_SPLIT = "\u0001"  # stands before and after each stretch in the model
_WILD = "\ue001"  # stands for a letter that is lost
#: Places of the model's tables: characters, then bins of hashed pairs and triples.
_PAIRS, _TRIPLES = 1 << 20, 1 << 22
_AT_PAIRS, _AT_TRIPLES = 1 << 16, (1 << 16) + _PAIRS
_PLACES = _AT_TRIPLES + _TRIPLES
_MIX = 0x9E3779B97F4A7C15


def _bytes_of(name: str) -> dict[int, str]:
    """Map from character to the Latin-1 character of its byte; undefined bytes stand for themselves."""
    table: dict[int, str] = {}
    for b in range(256):
        try:
            table[ord(bytes([b]).decode(name))] = chr(b)
        except UnicodeDecodeError:
            table.setdefault(b, chr(b))
    for c in range(0x80, 0xA0):
        table.setdefault(c, chr(c))
    for c in (0x20, 0x0A, 0x09):
        table[c] = chr(c)
    table[0xFFFD] = "\xff"
    for c in range(0x100):
        table.setdefault(c, "\ue000")  # not in the encoding
    return table


_ENCODE = {name: Table(_bytes_of(name)) for name in READ_AS}
CHAINS = [(w, t) for w in READ_AS for t in WRITTEN_IN if w != t]


_UTF8_FIRST = sorted(CHAINS, key=lambda c: c[1] != "utf-8")


def encoded(text: str, read_as: str) -> bytes | None:
    """The bytes of a text that was read as ``read_as``; None if it holds what that encoding can't give."""
    try:
        return text.translate(_ENCODE[read_as]).encode("latin-1")
    except UnicodeEncodeError:
        return None


def decode_chain(text: str, read_as: str, written_in: str) -> str | None:
    """The text as it was before it was read as ``read_as`` though written in ``written_in``; None if impossible.

    Bytes that got lost come back as U+FFFD.
    """
    raw = encoded(text, read_as)
    back = None if raw is None else raw.decode(written_in, "replace")
    return None if back == text else back


# --- the model -------------------------------------------------------------


def _place(gram: str) -> int:
    """Where the count of a gram of one to three characters lies."""
    key = 0
    for c in gram:
        key = key << 16 | min(ord(c), 0xFFFE)
    if len(gram) == 1:
        return key
    at, bits = (_AT_PAIRS, 44) if len(gram) == 2 else (_AT_TRIPLES, 42)
    return at + ((key * _MIX & 0xFFFFFFFFFFFFFFFF) >> bits)


def _places(codes: np.ndarray) -> np.ndarray:
    """Places of all grams of a run of UTF-16 code units."""
    c = codes.astype(np.uint64)
    pairs = c[:-1] << np.uint64(16) | c[1:]
    triples = pairs[:-1] << np.uint64(16) | c[2:]
    mix = np.uint64(_MIX)
    return np.concatenate([
        codes.astype(np.int64),
        (pairs * mix >> np.uint64(44)).astype(np.int64) + _AT_PAIRS,
        (triples * mix >> np.uint64(42)).astype(np.int64) + _AT_TRIPLES,
    ])


class CharModel:
    """Interpolated character trigram model with add-k back-off over tables of fixed size.

    ``counts`` holds the counts at the places of :func:`_place`; a dictionary of grams is taken too.
    """

    def __init__(self, counts: np.ndarray | dict[str, float]):
        if isinstance(counts, dict):
            table = np.zeros(_PLACES, np.float32)
            for gram, n in counts.items():
                table[_place(gram)] += n
            counts = table
        self.counts = counts
        self.total = float(counts[:_AT_PAIRS].sum(dtype=np.float64)) or 1.0
        self.log = lru_cache(maxsize=400_000)(self._log)

    def _log(self, gram: str) -> float:
        if gram[2] == _WILD:
            return -LOST
        n = self.counts
        p = (float(n[_place(gram[2])]) + 0.02) / (self.total + 0.02 * 60_000)
        if gram[1] != _WILD:
            p = (float(n[_place(gram[1:])]) + 5.0 * p) / (float(n[_place(gram[1])]) + 5.0)
            if gram[0] != _WILD:
                p = (float(n[_place(gram)]) + 5.0 * p) / (float(n[_place(gram[:2])]) + 5.0)
        return math.log(p)

    def score(self, text: str) -> float:
        s = _SPLIT + _SPLIT + text + _SPLIT
        log = self.log
        return sum(log(s[i : i + 3]) for i in range(len(s) - 2))


@lru_cache(maxsize=100_000)
def _decodes(token: str) -> bool:
    """Does some chain turn the token into a shorter one without loss, or is it all letters of a wrong code page?"""
    if _HIGH.search(token) and not _ASCII_LETTER.search(token):
        return True
    for w in READ_AS:
        back = decode_chain(token, w, "utf-8")
        if back is not None and len(back) < len(token) and "�" not in back and _readable(back):
            return True
    return False


def is_clean(text: str) -> bool:
    """Free of what wrong decoding leaves behind; such records train the model.

    Letters beyond ASCII are no reason to leave a record out: only tokens that a chain decodes whole, or that
    consist of nothing but letters of a code page's upper half, are.
    """
    if text.isascii():
        return "??" not in text
    if _UNCLEAN.search(text):
        return False
    return not any(ODD.search(t) and _decodes(t) for t in _TOKEN.findall(text))


def _held_out(text: str) -> bool:
    """A tenth of the distinct values validates the margin and doesn't train."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % 10 == 0


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts of 1- to 3-grams over a partition's clean records, by place."""
    total = np.zeros(_PLACES, np.int64)

    def add(texts: list[str]) -> None:
        joined = _SPLIT + _SPLIT + (_SPLIT + _SPLIT).join(texts) + _SPLIT
        joined = re.sub("[\ud800-\udfff\U00010000-\U0010ffff\uffff]", "\ufffe", re.sub("[ \n\t]", _SPLIT, joined))
        places = _places(np.frombuffer(joined.encode("utf-16-le"), np.uint16))
        total[:] += np.bincount(places, minlength=_PLACES)

    waiting, size = [], 0
    for pdf in batches:
        for t in pdf["value"]:
            if t and is_clean(t) and not _held_out(t):
                waiting.append(t)
                size += len(t)
                if size > 2_000_000:
                    add(waiting)
                    waiting, size = [], 0
    if waiting:
        add(waiting)
    k = np.flatnonzero(total)
    if len(k):
        yield pd.DataFrame({"place": k.astype(np.int32), "n": total[k]})


def train(values: DataFrame) -> CharModel:
    """Character model of a column ``value``, counted over its clean records (but for the held-out tenth).

    What reaches the driver are counts at the places of tables of fixed size, however many rows there are.
    """
    counts = values.where(F.col("value").isNotNull()).mapInPandas(_count_grams, "place int, n long")
    got = counts.groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(_PLACES, np.float32)
    table[got["place"].to_numpy()] = got["n"].to_numpy()
    return CharModel(table)


def validated_margin(values: DataFrame, model: CharModel, margin: float = MARGIN, least: int = 1_000) -> float:
    """The margin, raised to what all but a thousandth of the held-out clean stretches stay below (by twice at most).

    Gains of the likeliest chain are counted in whole units per stretch; fewer than ``least`` stretches leave the margin as it is.
    """
    spark = values.sparkSession
    shared = spark.sparkContext.broadcast(model.counts)

    def gains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lm = CharModel(shared.value)
        tally = np.zeros(1000, np.int64)
        for pdf in batches:
            for t in pdf["value"]:
                if t and not t.isascii() and _held_out(t) and ODD.search(t) and is_clean(t):
                    for a, b in stretches(t):
                        tally[min(999, math.ceil(_likeliest(t[a:b], lm)[0]))] += 1
        k = np.flatnonzero(tally)
        yield pd.DataFrame({"gain": k.astype(np.int32), "n": tally[k]})

    got = values.where(F.col("value").isNotNull()).mapInPandas(gains, "gain int, n long").groupBy("gain").agg(F.sum("n").alias("n")).collect()
    total, beyond = sum(r["n"] for r in got), 0
    if total < least:
        return margin
    for r in sorted(got, key=lambda r: -r["gain"]):
        beyond += r["n"]
        if beyond * 1000 > total:
            return min(2 * margin, max(margin, float(r["gain"])))
    return margin


# --- scoring one value -----------------------------------------------------


def _readable(text: str) -> bool:
    """Free of control, private-use and unassigned characters, which no original holds."""
    return text.isprintable() or all(c in " \n\t\r" or unicodedata.category(c) not in ("Cc", "Cn", "Co", "Cs") for c in text)


def _best(stretch: str, model: CharModel | None, depth: int = 0) -> tuple[float, str | None]:
    """Gain of the likeliest chain over the stretch as it stands, and what it gives."""
    spaced = re.sub(r"[ \t\n]+", _SPLIT, stretch)
    now = model.score(spaced) if model else _plain_score(spaced)
    best, to, seen = 0.0, None, set()
    lone = len(_EVIDENCE.findall(stretch)) < 2
    raws = {w: encoded(stretch, w) for w in READ_AS}
    for w, t in CHAINS if model else _UTF8_FIRST:
        if lone and t not in ("utf-8", "cp1254"):
            continue  # a single odd letter may be a foreign word's own; it can stand for no Arabic word
        raw = raws[w]
        back = None if raw is None else raw.decode(t, "replace")
        if back is None or back == stretch or back in seen:
            continue
        seen.add(back)
        if model is None and _AT_BEST * len(back) - now <= best:
            continue  # even text without a flaw would gain less
        s = re.sub(r"[ \t\n]+", _SPLIT, back)
        gain = (model.score(s) if model else _plain_score(s)) - LOST * back.count("�") - now
        if depth == 0 and t == "utf-8" and len(back) < len(stretch) and ODD.search(back):
            more, again = _best(back, model, 1)
            if again is not None and more > 0:
                gain, back = gain + more, again
        if gain > best and _readable(back):
            best, to = gain, back
    return best, to


def _loss(stretch: str, model: CharModel) -> float:
    """Gain of the chain that loses characters: what it left behind may have been any letter."""
    spaced = re.sub(r"[ \t\n]+", _SPLIT, stretch)
    return model.score(_LOST.sub(_WILD, spaced)) - model.score(spaced)


_likeliest_short = lru_cache(maxsize=50_000)(_best)


def _likeliest(stretch: str, model: CharModel | None) -> tuple[float, str | None]:
    return _likeliest_short(stretch, model) if len(stretch) < 40 else _best(stretch, model)


#: The plain score of a character that nothing speaks against.
_AT_BEST = -3.0


class _Kinds(dict):
    """Kind of each character: common (0), Arabic (1), accented or romanised Latin (2), other (3), lost (f)."""

    def __missing__(self, o: int) -> str:
        if o == 0xFFFD:
            kind = "f"
        elif o < 0x80 or 0x2010 <= o <= 0x2015 or o in (0x2026, 0xA0, 0xAC, 0xAD):
            kind = "0"
        elif 0x0621 <= o <= 0x0652 or 0x0660 <= o <= 0x0669 or o in (0x060C, 0x061B, 0x061F, 0x0670):
            kind = "1"
        elif o in (0x101, 0x12B, 0x16B, 0x2BE, 0x2BF) or 0x1E00 <= o < 0x1F00 or chr(o) in "éäüöçßèêâîôûğışİŞĞÜÖÇ":
            kind = "2"
        else:
            kind = "3"
        self[o] = kind
        return kind


_KINDS = _Kinds()


def _plain_score(text: str) -> float:
    """Costs by kind of character and of changes between kinds, for callers without a trained model."""
    count = text.translate(_KINDS).count
    two, three, lost = count("2"), count("3"), count("f")
    changes = sum(map(count, ("12", "13", "21", "23", "31", "32", "f1", "f2")))
    return _AT_BEST * (len(text) - two - three - lost) - 6.0 * two - 11.0 * three - 4.0 * lost - 3.0 * changes


def stretches(text: str) -> list[tuple[int, int]]:
    """Runs of tokens that hold an odd character, over gaps of tokens without letters."""
    out: list[tuple[int, int]] = []
    bridge = False
    for m in _TOKEN.finditer(text):
        tok = m.group()
        if ODD.search(tok) or (bridge and tok in ("?", "\xbf")):
            if bridge and out:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append((m.start(), m.end()))
            bridge = True
        elif any(c.isalpha() for c in tok):
            bridge = False
    return out


def garbled(text: str, model: CharModel | None = None, margin: float = MARGIN) -> list[tuple[int, int, str | None]]:
    """Garbled stretches of a text as (start, end, repair); the repair is None where the text is lost."""
    if not text or not ODD.search(text):
        return []
    found: list[tuple[int, int, str | None]] = []
    tail = len(text.rstrip())
    for start, end in stretches(text):
        parts = [(start, end)]
        signs = len(_EVIDENCE.findall(text, start, end))
        if not signs or model is None and (signs < 2 or signs * 5 < end - start):
            continue  # without a model, single odd characters prove nothing
        gain, back = _likeliest(text[start:end], model)
        if back is None:  # a clean word may stick to the stretch: try its tokens one by one
            parts = [(start + m.start(), start + m.end()) for m in _TOKEN.finditer(text[start:end])]
        for a, b in parts:
            piece = text[a:b]
            if (a, b) != (start, end):
                gain, back = _likeliest(piece, model) if _EVIDENCE.search(piece) else (0.0, None)
            if back is not None and gain > margin:
                found.append((a, b, back))
            elif _lossy(piece, b == tail, model, margin):
                found.append((a, b, None))
    return found


def _lossy(piece: str, last: bool, model: CharModel | None, margin: float) -> bool:
    """Has decoding lost characters of the piece? A lone replacement sign at a text's end is a cut, not a case."""
    if not _LOST.search(piece) or last and piece.count("�") == 1 and len(_LOST.findall(piece)) == 1:
        return False
    return model is None or _loss(piece, model) > margin


def repaired(text: str, spans: list[tuple[int, int, str | None]]) -> str:
    for a, b, back in reversed(spans):
        if back is not None:
            text = text[:a] + back + text[b:]
    return text


def without(text: str, spans: list[tuple[int, int, str | None]]) -> str:
    for a, b, _ in reversed(spans):
        text = text[:a] + " " + text[b:]
    return text


# --- the operator ----------------------------------------------------------


def garbled_values(df: DataFrame, key: str, fields: tuple[str, ...], margin: float = MARGIN) -> DataFrame:
    """Garbled values: (key, field, value, repaired, n_spans), one row per affected value.

    One model per field is trained on the field's clean records over the whole table, and the margin is
    validated on those held out. Null and
    empty values are never garbled; equal values get equal results; ``repaired`` is null where no
    chain restores the text in full (it may then still be restored in part in ``partial``). Other
    columns of ``df`` play no part, whatever their names.
    """
    spark = df.sparkSession
    models = {f: train(df.select(F.col(f).cast("string").alias("value"))) for f in fields}
    margins = {f: validated_margin(df.select(F.col(f).cast("string").alias("value")), m, margin) for f, m in models.items()}
    shared = spark.sparkContext.broadcast({f: m.counts for f, m in models.items()})
    slim = df.select(F.col(key).alias("_key"), *[F.col(f).cast("string").alias(f"_v{i}") for i, f in enumerate(fields)])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lm = {f: CharModel(g) for f, g in shared.value.items()}
        for pdf in batches:
            out = []
            keys = pdf["_key"].tolist()
            for i, f in enumerate(fields):
                for k, v in zip(keys, pdf[f"_v{i}"].tolist()):
                    if not v or v.isascii() and "??" not in v or not ODD.search(v):
                        continue
                    spans = garbled(v, lm[f], margins[f])
                    if spans:
                        whole = repaired(v, spans)
                        full = all(b is not None and "�" not in b for _, _, b in spans)
                        out.append((k, f, v, whole if full else None, whole, len(spans)))
            yield pd.DataFrame(out, columns=["_key", "field", "value", "repaired", "partial", "n_spans"])

    kind = dict(slim.dtypes)["_key"]
    found = slim.mapInPandas(scan, f"_key {kind}, field string, value string, repaired string, partial string, n_spans int")
    return found.withColumnRenamed("_key", key)
