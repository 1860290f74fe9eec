"""Row-level text preparation in plain Python, for use inside Arrow UDFs.

The Column versions live in ``normalize``; both share the fixed values below and
are tested against each other.
"""

from __future__ import annotations

import re
import unicodedata

# The code points that the normalisation modes treat specially.
DIACRITICS = "".join(map(chr, range(0x064B, 0x0660))) + "ٰ"
TATWEEL = "ـ"
FOLD_FROM = "آأإٱىئیؤک"
FOLD_TO = "اااايييوك"
TA_MARBUTA, HEH = "ة", "ه"
PUNCTUATION = "،؛؟٪٫٬٭۔!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~—–"
LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"



class Table(dict):
    """A table for ``str.translate`` that remembers which characters stay: misses cost an exception each."""

    def __missing__(self, code: int) -> int:
        self[code] = code
        return code


_LINE_NO = re.compile(r"^\s*\d+\s*[\t.)]\s*")
_MARKS = {ord(c): None for c in DIACRITICS + TATWEEL}
_FOLD = Table({ord(a): b for a, b in zip(FOLD_FROM, FOLD_TO)})
_PUNCT = Table({ord(c): " " for c in PUNCTUATION})
_ALL = Table({**_PUNCT, **_FOLD, **_MARKS})
_KEEP = re.compile(f"[^{DIACRITICS}]")
MODES = ("raw", "normalized", "no_tashkeel", "tashkeel_only")


def strip_line_numbers(text: str) -> str:
    return "\n".join(_LINE_NO.sub("", line) for line in text.splitlines())


def preprocess(text: str | None, mode: str = "raw") -> str:
    """One of the four normalisation modes; None counts as the empty text."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode!r}")
    if not text:
        return ""
    text = " ".join(strip_line_numbers(unicodedata.normalize("NFC", text)).split())
    if mode == "raw":
        return text
    if mode == "tashkeel_only":
        return _KEEP.sub("", text)
    if mode == "no_tashkeel":
        return " ".join(text.translate(_ALL).split())
    return " ".join(text.translate(_FOLD).translate(_PUNCT).split())
