"""Character facts shared by the text operators."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Characters that leave no mark on the page.
INVISIBLE = "\x00-\x08\x0e-\x1b\x7f\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff"
# White space other than space, tab and line feed.
ODD_SPACE = "\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Blocks of wide, narrow and joined presentation variants.
PRESENTATION = "\ufb00-\ufdff\ufe70-\ufefc\uff01-\uffee\U0001d400-\U0001d7ff"
SINGLE_SIGN = "ﷺ"  # one sign of its own, not a variant spelling

# Arabic letters and digits that look the same; in each class the corpus decides which one is meant.
LOOKALIKE_CLASSES = ("كک", "هہھە", "يی", "ةۃ", "٠۰", "١۱", "٢۲", "٣۳", "٧۷", "٨۸", "٩۹")
# Letters of other scripts and the Latin letters they look like.
CONFUSABLE_LATIN = {
    "АВЕЗКМНОРСТУХЅІЈԌԚԜҮѴ": "ABE3KMHOPCTYXSIJGQWYV",
    "аеорсухѕіјһԁԛԝѵүо": "aeopcyxsijhdqwvyo",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "ονυ": "ovu",
}
TO_LATIN = {a: b for k, v in CONFUSABLE_LATIN.items() for a, b in zip(k, v)}


@lru_cache(maxsize=65536)
def script(ch: str) -> str:
    """Script of a letter, '' for characters common to all scripts."""
    if not ch.isalpha():
        return ""
    return unicodedata.name(ch, "").split(" ")[0]


#: Scripts whose letters are compared with each other; Arabic has classes of its own.
ALIKE_SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "COPTIC", "CHEROKEE", "GEORGIAN", "LISU")


def skeletons(spark) -> dict[str, str]:
    """Each letter's prototype under the Unicode confusables, as the ICU library in Spark's JVM has them.

    Without them it is an error: the few built-in look-alikes would give a result that can't be told from a whole one.
    """
    letters = [c for c in map(chr, range(0x41, 0x10000)) if script(c) in ALIKE_SCRIPTS]
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        found = checker.getSkeleton("\n".join(letters)).split("\n")
    except Exception as e:  # noqa: BLE001 - py4j gives a different error for each of no JVM, no library and a fault in it
        raise RuntimeError("can't read the Unicode confusables: Spark's JVM must be at hand and have the ICU library (icu4j)") from e
    if len(found) != len(letters):
        raise RuntimeError(f"the ICU library gave {len(found)} prototypes for {len(letters)} letters")
    return dict(zip(letters, found))


def alike(letters: dict[str, int], looks: dict[str, str] | None = None) -> dict[str, dict[str, str]]:
    """For each letter with look-alikes in other scripts: script -> the letter that it has there.

    Only letters that the corpus uses (``letters`` counts them) are taken as another's spelling, the commonest of
    each script; without counts all are. ``looks`` comes from :func:`skeletons`; callers that pass
    none get the built-in look-alikes of Latin letters.
    """
    if looks is None:
        looks = {a: b for a, b in TO_LATIN.items()} | {b: b for b in TO_LATIN.values()}
    classes: dict[tuple[str, bool], dict[str, str]] = {}  # by prototype and case
    for c, look in looks.items():
        if letters and not letters.get(c):
            continue
        held = classes.setdefault((look, c.isupper()), {})
        s = script(c)
        if s not in held or (letters.get(c, 0), c == look) > (letters.get(held[s], 0), held[s] == look):
            held[s] = c
    out = {}
    for c, look in looks.items():
        other = {s: x for s, x in classes.get((look, c.isupper()), {}).items() if s != script(c)}
        if other:
            out[c] = other
    return out
