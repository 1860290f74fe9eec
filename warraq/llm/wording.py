"""A transcription as a sequence of comparable words."""

from __future__ import annotations

import re

from warraq.functions.pytext import preprocess
from warraq.llm import mojibake
from warraq.llm.homoglyph import Form

#: Stands for a word that the annotator could not read.
ABSTAIN = ""
# The project's mark for an unreadable span, and its start of a comment line.
UNREADABLE = re.compile(r"\[\s*غير واضح\s*\]")
COMMENT = "#"

_MARKS = re.compile("[\u0640\u064b-\u065f\u0670]")
# Words that go with the number of a page or leaf, and letters for its sides.
FOLIO_WORDS = "ورقة|صفحة|الورقة|الصفحة|ص|ق|page|pag|p|folio|fol|f|ff|leaf"
_DIGIT = re.compile(r"\d")
_FOLIO = re.compile(
    rf"[\W_]*(?:\d+[\W_]*(?:[أابrvab][\W_]*)?(?:\d+[\W_]*)?|(?:{FOLIO_WORDS})[\W_]*\d+[\W_]*(?:[أابوظrvab][\W_]*)?)", re.IGNORECASE
)


def lines_of(text: str) -> list[str]:
    return [x for x in text.split("\n") if x.strip() and not x.lstrip().startswith(COMMENT)]


def is_folio(line: str) -> bool:
    """A page or leaf number and nothing else."""
    if len(line) > 80 or not _DIGIT.search(line):
        return False
    return _FOLIO.fullmatch(_MARKS.sub("", line)) is not None


def words_of(text: str, form: Form) -> list[str]:
    """The text's words after the no_tashkeel mode, look-alikes unified, comment lines left out."""
    text = form.apply(text)
    if COMMENT in text:
        text = "\n".join(x for x in text.split("\n") if not x.lstrip().startswith(COMMENT))
    if "[" in text:
        text = UNREADABLE.sub(f" {ABSTAIN} ", text)
    return preprocess(text, "no_tashkeel").split()


def repaired_text(text: str) -> str:
    """The text with garbled stretches restored as far as encodings alone tell."""
    spans = mojibake.garbled(text)
    return mojibake.repaired(text, spans) if spans else text


def body_words(text: str, form: Form) -> list[str]:
    """The words of the running text: wrong decoding repaired, page numbers at either end left out."""
    lines = lines_of(form.apply(repaired_text(text)))
    while lines and is_folio(lines[-1]):
        lines.pop()
    while lines and is_folio(lines[0]):
        lines.pop(0)
    return words_of("\n".join(lines), form)


def distance(a: str, b: str) -> int:
    """Edit distance of two words."""
    if a == b:
        return 0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def likeness_cost(a: str, b: str) -> float:
    """0 for equal words up to 1 for unrelated ones; an abstention fits any word."""
    if a == b or ABSTAIN in (a, b):
        return 0.0
    return distance(a, b) / max(len(a), len(b))
