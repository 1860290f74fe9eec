"""Text that looks the same but differs in its characters, brought to one form.

Each token's resolved script sets (the scripts its characters or their look-alikes occur in) are
intersected. A token of several scripts that one script can write is a mixed confusable, a token of one
script that another can write too a whole-script one; both are spelled in the script that the line's
unmistakable letters, or else the corpus's, speak for. A token that no single script can write holds a
misread character and stays. Which letters look alike comes from the Unicode confusables. What remains (wide, narrow and joined variants, invisible characters, spaces,
composition, look-alike Arabic letters and digits) is normalised to the corpus's choice.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.llm import mojibake
from warraq.llm.chars import (
    INVISIBLE,
    LOOKALIKE_CLASSES,
    ODD_SPACE,
    PRESENTATION,
    SINGLE_SIGN,
    alike,
    script,
    skeletons,
)

_INVISIBLE = re.compile(f"[{INVISIBLE}]+")
_SPACE = re.compile(f"[{ODD_SPACE}]")
_VARIANT = re.compile(f"(?!{SINGLE_SIGN})[{PRESENTATION}]+")
_WORD = re.compile(r"[^\W\d_]+")
_JOINING = re.compile("[\u064b-\u065f\u0670]*[\u0621-\u06d3]")
_MEMBERS = {c: k for k in LOOKALIKE_CLASSES for c in k}


def default_choice() -> dict[str, str]:
    """Look-alike classes resolved to their first member, for callers without corpus counts."""
    return {c: k[0] for c, k in _MEMBERS.items() if c != k[0]}


class Form:
    """The corpus's consistent form: which member of each look-alike class, which scripts come first.

    ``letters`` counts the corpus's letters, ``looks`` gives their prototypes (see ``chars.skeletons``).
    """

    def __init__(self, letters: dict[str, int] | None = None, looks: dict[str, str] | None = None):
        letters = letters or {}
        self.choice = default_choice()
        for k in LOOKALIKE_CLASSES:
            best = max(k, key=lambda c: (letters.get(c, 0), -k.index(c)))
            for c in k:
                self.choice.pop(c, None)
                if c != best:
                    self.choice[c] = best
        self.alike = alike(letters, looks)
        # How many letters of each script can be no other's; scripts of before the counts are known follow this order.
        self.clear: dict[str, int] = {"LATIN": 2, "CYRILLIC": 1} if not letters else {}
        for c, n in letters.items():
            if (s := script(c)) and c not in self.alike:
                self.clear[s] = self.clear.get(s, 0) + n
        foreign = "".join(c for c in self.alike if script(c) != "LATIN")
        self.foreign = re.compile(f"[{foreign}]") if foreign else re.compile(r"(?!)")
        self.minor = re.compile("[" + "".join(self.choice) + "]")
        self.hint = re.compile(f"[{INVISIBLE}{ODD_SPACE}{foreign}{''.join(self.choice)}]|(?!{SINGLE_SIGN})[{PRESENTATION}]")

    def apply(self, text: str) -> str:
        """The text in the consistent form; a text already in it comes back unchanged."""
        if not self.hint.search(text):
            return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        text = _SPACE.sub(" ", _INVISIBLE.sub("", text))
        text = _VARIANT.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
        text = unicodedata.normalize("NFC", text)
        if self.foreign.search(text):
            text = "\n".join(self._spell_line(x) if self.foreign.search(x) else x for x in text.split("\n"))
        if self.minor.search(text):
            text = "".join(self._letter(text, i) for i in range(len(text)))
        return unicodedata.normalize("NFC", text)

    def _letter(self, text: str, i: int) -> str:
        c = text[i]
        to = self.choice.get(c, c)
        if c == "ی" and not _JOINING.match(text, i + 1):
            return "ى"  # its final form has no dots
        return to

    def _spell_line(self, line: str) -> str:
        here: dict[str, int] = {}
        for c in line:
            if c not in self.alike and (s := script(c)):
                here[s] = here.get(s, 0) + 1
        return _WORD.sub(lambda m: self.spell(m.group(), here), line)

    def spell(self, token: str, here: dict[str, int] | None = None) -> str:
        """The token in one script, where look-alikes allow it; ``here`` counts unmistakable letters around it by script."""
        if token.isascii() or not any(c in self.alike for c in token):
            return token
        sets = [{s, *self.alike.get(c, ())} for c in token if (s := script(c))]
        shared = set.intersection(*sets)
        if not shared:
            return token  # no single script can write it: a misread character, not a look-alike
        target = max(shared, key=lambda s: ((here or {}).get(s, 0) > 0, self.clear.get(s, 0), s))
        return "".join(c if script(c) in ("", target) else self.alike[c][target] for c in token)


def letter_counts(values: DataFrame) -> dict[str, int]:
    """How often each letter and digit of column ``value`` occurs, over all rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0x10000, np.int64)
        for pdf in batches:
            joined = "".join(t for t in pdf["value"] if t)
            for at in range(0, len(joined), 1 << 22):
                raw = joined[at : at + (1 << 22)].encode("utf-16-le", "surrogatepass")
                total += np.bincount(np.frombuffer(raw, np.uint16), minlength=0x10000)
        k = np.flatnonzero(total)
        yield pd.DataFrame({"ch": k.astype(np.int32), "n": total[k]})

    rows = values.where(F.col("value").isNotNull()).mapInPandas(count, "ch int, n long").groupBy("ch").agg(F.sum("n").alias("n")).collect()
    return {chr(r["ch"]): r["n"] for r in rows if not 0xD800 <= r["ch"] <= 0xDFFF and chr(r["ch"]).isalnum()}


def consistent_form(df: DataFrame, key: str, text: str, only_changed: bool = False) -> DataFrame:
    """(key, consistent, changed) for every row; garbled stretches are left as they are.

    ``changed`` says that the text wasn't in the corpus's consistent form. Null gives null and false,
    the empty text itself. With ``only_changed`` the rows that needed no change are left out.
    """
    form = Form(letter_counts(df.select(F.col(text).cast("string").alias("value"))), skeletons(df.sparkSession))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, out, changed = [], [], []
            for k, t in zip(pdf["_key"].tolist(), pdf["_text"].tolist()):
                new, c = (None, False) if t is None else apply_outside(form, t)
                if c or not only_changed:
                    keys.append(k), out.append(new), changed.append(c)
            yield pd.DataFrame({"_key": pd.Series(keys, dtype=pdf["_key"].dtype), "consistent": pd.Series(out, dtype=object), "changed": pd.Series(changed, dtype=bool)})

    slim = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kind = dict(slim.dtypes)["_key"]
    return slim.mapInPandas(scan, f"_key {kind}, consistent string, changed boolean").withColumnRenamed("_key", key)


def apply_outside(form: Form, text: str) -> tuple[str, bool]:
    """The form applied outside garbled stretches, and whether that changed anything."""
    new = form.apply(text)
    if new == text:
        return text, False
    spans = mojibake.garbled(text)
    if not spans:
        return new, True
    pieces, at = [], 0
    for a, b, _ in spans:
        pieces += [form.apply(text[at:a]), text[a:b]]
        at = b
    pieces.append(form.apply(text[at:]))
    new = "".join(pieces)
    return new, new != text
