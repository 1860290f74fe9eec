"""Noise in text from scanned pages: broken words, misread characters, running headers, page numbers.

The lines of each recognised text are labelled header, page number or body by a hidden Markov model
over layout features (place on the page, shape, share of words that the page's annotators wrote too)
and the words of lines the annotators did not write. The model is trained by expectation-maximisation
on all rows. A second chain labels the line ends of running text as break or not, by the stop at the end,
the line's length, and blank or indented lines after it; it is trained likewise. Body lines are then put
together into paragraphs that end at breaks: broken words are joined, misread characters replaced by the
letter of the annotators' word.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.functions.pytext import DIACRITICS, FOLD_FROM, FOLD_TO, PUNCTUATION, TATWEEL, Table
from warraq.llm import mojibake
from warraq.llm.chains import forward_backward
from warraq.llm.homoglyph import Form
from warraq.llm.truncation import TAIL, verdict
from warraq.llm.wording import is_folio, lines_of, repaired_text, words_of
from warraq.session import checkpoint, hot_keys, salted_join, spread

KINDS = ("hyphen", "char", "header", "pageno")
ROUNDS = 5
WORD_BINS = 1 << 14
#: Annotator rows of a page from which on its reference is made beforehand, and rows a task then takes at once.
CROWD = 64
ROWS_PER_SALT = 1_000
BODY, HEADER, FOLIO = range(3)
FIRST_SYMBOL = 0x100
# Signs of a paragraph's end at a line's end, added up to a digit.
STOP, SHORT, GAP = 1, 2, 4

_MARKS = re.compile("[ـً-ٰٟ]+")
_SKELETON = Table({**{ord(a): b for a, b in zip(FOLD_FROM, FOLD_TO)}, **{ord(c): None for c in DIACRITICS + TATWEEL}})
_WORDS = Table({**{ord(c): " " for c in PUNCTUATION}, **_SKELETON})
_LETTER = "ء-غف-ي"
_HAS_ARABIC = re.compile(f"[{_LETTER}]")
_FOREIGN = re.compile(f"[^{_LETTER}]")
_ODD_TOKEN = re.compile(f"\\S*[^{_LETTER}\\s]\\S*")
_CERTAIN = re.compile(f"[{_LETTER}][0-9٠-٩A-Za-z%*~|<>=+/'][{_LETTER}]|[A-Za-z\u066e-\u06d3]")
_PUNCTUATED = re.compile(f"[{_LETTER}][،؛؟:.,()\\[\\]][{_LETTER}]")
_LINE_NO = re.compile(r"^\s*\d+\s*[\t.)]\s*")
_BREAK_SIGNS = "-\xac~=._*‐‑‒–—―…\xad"
_TRIM = "،؛؟٪٭۔!\"'()*,-./:;<=>?[\\]_`{|}~—–\xac…«»"
_NUMBERED = re.compile(r"\d")
_ENDS = re.compile(r"[.؟?!:۔][\s\"'»”)\]]*$")


def skeleton(token: str) -> str:
    return token.translate(_SKELETON)


class Known:
    """Words, pairs, tokens, numbers, page-number lines and endings of any number of texts.

    Its size is bounded by the spellings that occur, not by the texts; parts may be merged.
    """

    SETS = ("words", "pairs", "tokens", "numbers", "folios")

    def __init__(self) -> None:
        self.words: set[str] = set()
        self.pairs: set[tuple[str, str]] = set()
        self.tokens: set[str] = set()
        self.numbers: set[str] = set()
        self.folios: set[str] = set()
        self.tails: dict[str, tuple[int, int]] = {}  # ending -> texts with it, words of the longest

    def add(self, texts: Iterable[str], form: Form) -> None:
        seen: dict[str, list[str]] = {}  # the annotators of a page share most lines
        for t in texts:
            w: list[str] = []
            for line in lines_of(form.apply(repaired_text(t))):
                words = seen.get(line)
                if words is None:
                    words = seen[line] = words_of(line, form)
                    self.words.update(words)
                    self.tokens.update(skeleton(line).split())
                    if _NUMBERED.search(line):
                        self.numbers.update(str(int(x)) for x in re.findall(r"\d+", _LINE_NO.sub("", line)))
                        if is_folio(line):
                            self.folios.add(_key(line))
                w += words
            self.pairs.update(zip(w, w[1:]))
            self._end(" ".join(w[-TAIL:]), 1, len(w))

    def _end(self, tail: str, texts: int, words: int) -> None:
        n, most = self.tails.get(tail, (0, 0))
        self.tails[tail] = (n + texts, max(most, words))

    def merge(self, other: Known) -> None:
        for name in self.SETS:
            getattr(self, name).update(getattr(other, name))
        for tail, (n, words) in other.tails.items():
            self._end(tail, n, words)

    def whole_tails(self) -> set[str]:
        """The endings of the texts that reach the page's end: an annotator's text may be cut, too."""
        if not self.tails:
            return set()
        end = max(self.tails, key=lambda t: (self.tails[t], t))
        return {t for t, (_, words) in self.tails.items() if words >= self.tails[end][1] or not verdict(t, end)}

    def dumps(self) -> bytes:
        sets = {name: sorted(getattr(self, name)) for name in self.SETS}
        return zlib.compress(json.dumps([sets, self.tails]).encode("utf-8", "surrogatepass"))

    @classmethod
    def loads(cls, raw: bytes) -> Known:
        sets, tails = json.loads(zlib.decompress(raw).decode("utf-8", "surrogatepass"))
        out = cls()
        for name in cls.SETS:
            setattr(out, name, {tuple(x) for x in sets[name]} if name == "pairs" else set(sets[name]))
        out.tails = {t: tuple(x) for t, x in tails.items()}
        return out


class Page:
    """What a page's annotators wrote, all of them, prepared for look-ups."""

    def __init__(self, texts: Iterable[str], form: Form, known: Known | None = None):
        self.known = known or Known()
        self.known.add(texts, form)
        self.words, self.pairs, self.tokens = self.known.words, self.known.pairs, self.known.tokens
        self.numbers, self.folios = self.known.numbers, self.known.folios
        self.tails = self.known.whole_tails()
        self.near = {w[:i] + "." + w[i + 1 :] for w in self.words if len(w) > 2 for i in range(len(w))}
        self.lengths: dict[int, list[str]] = {}
        for w in sorted(self.words):
            self.lengths.setdefault(len(w), []).append(w)

    def knows(self, word: str) -> bool:
        """The annotators wrote the word, or one that differs by a single letter."""
        if word in self.words:
            return True
        return len(word) > 2 and any(word[:i] + "." + word[i + 1 :] in self.near for i in range(len(word)))

    def word_for(self, core: str, misread: int = 1) -> str | None:
        """The annotators' word that ``core`` stands for when its foreign characters are letters."""
        best, cost = None, misread + 1
        for w in self.lengths.get(len(core), ()):
            wrong = 0
            for a, b in zip(core, w):
                if a != b and ("ء" <= a <= "ي" and a != "ـ"):
                    wrong += 1
                    if wrong >= cost:
                        break
            else:
                best, cost = w, wrong
        return best


def _key(line: str) -> str:
    return re.sub(r"[\W_]+", " ", skeleton(line)).strip()


def misread_in(sk: str, page: Page) -> str | None:
    """The annotators' word where the skeleton ``sk`` of a token has a foreign character in a letter's place, else None."""
    core = sk.strip(_TRIM)
    if core in page.words or not _HAS_ARABIC.search(sk) or sk in page.tokens:
        return None
    left, right = len(sk) - len(sk.lstrip(_TRIM)), len(sk) - len(sk.rstrip(_TRIM))
    tries = [sk[a : len(sk) - b] for a in range(left + 1) for b in range(right + 1)]
    for t in dict.fromkeys(tries):
        if not _FOREIGN.search(t):
            continue
        letters = sum("ء" <= c <= "ي" for c in t)
        if letters * 2 < len(t) or len(t) - letters > 2:
            continue
        word = page.word_for(t, 1 if len(t) > 4 else 0)
        if word:
            return word
    if _CERTAIN.search(core) and not _PUNCTUATED.search(core):
        return "\ufffd"  # surely misread, though the annotators' word isn't known
    return None


def joined_word(first: str, second: str, page: Page) -> str | None:
    """The word that the end of one line and the start of the next are parts of, else None."""
    a, b = first.rstrip(_BREAK_SIGNS), second.strip(_TRIM)
    signed = first[-1:] in "\xac\xad‐‑~_" or first.endswith((".-", "--"))
    if not a or not b or not _HAS_ARABIC.search(a) or not _HAS_ARABIC.search(b):
        return None
    if first[-1] in "،؛:؟!?)].":  # punctuation ends a word
        return None
    if (a, b) in page.pairs:
        return None
    whole = a + b
    if whole in page.words:
        return whole
    if len(whole) >= 4 and len(_FOREIGN.findall(whole)) <= signed:
        hit = page.word_for(whole, 1 if len(whole) < 7 else 2)
        if hit and (signed or first[-1:] in _BREAK_SIGNS or not (page.knows(a) and page.knows(b))):
            if (a in page.words and b in page.words) and not signed:
                return None
            return hit
    return None


# --- lines -------------------------------------------------------------------


def _symbol(shape: str, place: str, share: float | None, flaw: int = 0) -> str:
    """One letter for the features of a line: shape, share of known words, place, and flaws (1 a word broken at its end or start, 2 a misread character)."""
    know = 0 if share is None else 1 if share <= 0.34 else 2 if share <= 0.6 else 3
    return chr(FIRST_SYMBOL + (("ndt".index(shape) * 4 + know) * 4 + "fsil".index(place)) * 4 + flaw)


def _features(symbol: str) -> tuple[str, int, str, int]:
    """Shape, share of known words, place and flaws of a symbol."""
    code = ord(symbol) - FIRST_SYMBOL
    return "ndt"[code // 64], code // 16 % 4, "fsil"[code // 4 % 4], code % 4


def sure(symbol: str) -> bool:
    """The annotators wrote the line too, which makes it text by definition."""
    shape, know, _, _ = _features(symbol)
    return shape != "n" and know == 3


def uncertain_part(symbols: str, bins: list[str]) -> tuple[str, list[str], list[int]]:
    """The lines that are not sure, with the sure ones next to them; the chain falls apart at sure lines."""
    known = [sure(s) for s in symbols]
    n = len(known)
    keep = [i for i in range(n) if not known[i] or i and not known[i - 1] or i + 1 < n and not known[i + 1]]
    if all(known[i] for i in keep):
        return "", [], []
    return "".join(symbols[i] for i in keep), [bins[i] for i in keep], keep


def read_lines(text: str, page: Page, left: frozenset[str] = frozenset()) -> tuple[str, list[list[int]], list[tuple[str, str | None, dict[str, str], bool]], list[str]]:
    """What the lines of a text in the consistent form look like.

    Returns their symbols, the word bins of those the annotators did not write, per line (text, word
    joined with the next line, misread tokens with their words, page number beside it), and the words
    of the last lines. Lines in ``left`` are passed by as text.
    """
    lines = lines_of(text)
    bodies = [_LINE_NO.sub("", x) for x in lines]
    numbered = sum(len(a) != len(b) for a, b in zip(lines, bodies)) * 2 > len(lines)
    joined = "\n".join(bodies)
    bones = joined.translate(_SKELETON).split("\n")
    words = [x.split() for x in joined.translate(_WORDS).split("\n")]
    folios = [is_folio(x) for x in lines]
    digits = [_NUMBERED.search(x) is not None for x in bodies]
    kept = [[w for w in x if not w.isdigit()] if d else x for x, d in zip(words, digits)]
    known = [sum(map(page.knows, w)) for w in kept]
    # Words broken over a line end; both parts count as known, as the annotators wrote the whole.
    joins: list[str | None] = [None] * len(lines)
    second: set[int] = set()
    real = [i for i, w in enumerate(kept) if w and not folios[i] and lines[i] not in left and (known[i] > 0.3 * len(w) or len(w) == 1)]
    for i, j in zip(real, real[1:]):
        a, b = bones[i].split(), bones[j].split()
        if a and b and not (left and any(x in left for x in lines[i + 1 : j])):
            last = a[-1] if len(a) == 1 or a[-1].strip(_BREAK_SIGNS) else a[-2] + a[-1]
            joins[i] = joined_word(last, b[0], page)
            if joins[i] is not None:
                known[i] += not page.knows(kept[i][-1])
                known[j] += not page.knows(kept[j][0])
    symbols, bins, out = [], [], []
    for i, line in enumerate(lines):
        place = "f" if i == 0 else "l" if i == len(lines) - 1 else "s" if i in (1, len(lines) - 2) else "i"
        share = known[i] / len(kept[i]) if kept[i] else None
        folio = folios[i]
        if line in left:
            symbols.append(_symbol("t", place, 1.0))
            bins.append([])
            out.append((line, None, {}, False))
            continue
        if folio and (_key(line) in page.folios or numbered and not words[i] and place == "i"):
            share, folio = 1.0, False
        odd = share is not None and share <= 0.6 and not folio
        bins.append([zlib.crc32(x.encode()) % WORD_BINS for x in kept[i]] if odd else [])
        misread = {}
        if not folio:
            tokens = bones[i].split()
            for m in _ODD_TOKEN.finditer(bones[i]):
                if joins[i] is not None and m.group() == tokens[-1]:
                    continue  # the sign at the break is no letter's stand-in
                hit = misread_in(m.group(), page)
                if hit is not None:
                    misread[next((x for x in bodies[i].split() if skeleton(x) == m.group()), m.group())] = hit
        broken = joins[i] is not None or i in second
        symbols.append(_symbol("n" if folio else "d" if digits[i] else "t", place, share, broken + 2 * bool(misread)))
        beside = digits[i] and any(str(int(x)) not in page.numbers for x in re.findall(r"\d+", bodies[i]))
        out.append((line, joins[i], misread, beside))
    tail = [w for x, f in zip(words[-4:], folios[-4:]) if not f for w in x][-TAIL:]
    return "".join(symbols), bins, out, tail


# --- paragraph breaks --------------------------------------------------------


def line_ends(text: str) -> str:
    """A digit for each line of :func:`lines_of`: does it end with a stop, is it short, does a blank or an indented line follow?"""
    lines: list[str] = []
    gaps: list[bool] = []
    for x in text.rstrip().split("\n"):
        if not x.strip():
            if gaps:
                gaps[-1] = True
        elif not x.lstrip().startswith("#"):
            if gaps and x[:1] in " \t" and lines[-1][:1] not in " \t":
                gaps[-1] = True
            lines.append(x)
            gaps.append(False)
    sizes = sorted(map(len, lines))
    usual = sizes[len(sizes) // 2] if sizes else 0
    return "".join(str(STOP * (_ENDS.search(x) is not None) + SHORT * (len(x) < 0.7 * usual) + GAP * g) for x, g in zip(lines, gaps))


_BITS = np.array([[d & STOP > 0, d & SHORT > 0, d & GAP > 0] for d in range(8)])


class BreakModel:
    """Chain of line ends that break the paragraph or don't: chances of each sign in either state, and transitions."""

    #: Starting belief (stop, short, gap): a break mostly has a stop and a short line or a gap, other ends mostly nothing of it.
    PRIOR = np.array([[0.2, 0.03, 0.005], [0.8, 0.92, 0.4]])

    def __init__(self, signs: np.ndarray | None = None, trans: np.ndarray | None = None):
        self.signs = self.PRIOR if signs is None else signs
        self.trans = np.array([[0.8, 0.2], [0.95, 0.05]]) if trans is None else trans
        self.emit = np.stack([np.where(_BITS, p, 1 - p).prod(axis=1) for p in self.signs])

    def marginals(self, ends: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Chance of a break at each line of a batch, expected transitions, the digits, and where lines are."""
        size = np.array([len(x) for x in ends])
        mask = np.arange(size.max()) < size[:, None]
        digits = np.zeros(mask.shape, np.int64)
        digits[mask] = np.frombuffer("".join(ends).encode(), np.uint8) - ord("0")
        odds = np.log(self.emit[1] / self.emit[0])
        marg, pair = forward_backward(np.where(mask, odds[digits], 0.0), mask, np.log(self.trans))
        return marg, pair, digits, mask

    def breaks(self, ends: str) -> list[bool]:
        """Which line ends are likelier a break than not, as :meth:`marginals` has it, for a single text."""
        if not ends:
            return []
        odds = (self.emit[1] / self.emit[0]).tolist()
        (t00, t01), (t10, t11) = self.trans.tolist()
        o = [odds[ord(x) - 48] for x in ends]
        ahead = [1.0] * len(o)
        for i in range(len(o) - 2, -1, -1):
            x = o[i + 1] * ahead[i + 1]
            ahead[i] = (t10 + t11 * x) / (t00 + t01 * x)
        out, r = [], 0.0
        for i, x in enumerate(o):
            r = x * (t01 + r * t11) / (t00 + r * t10) if i else x
            out.append(r * ahead[i] > 1)
        return out


def fit_breaks(ends: DataFrame, rounds: int = 4) -> BreakModel:
    """Expectation-maximisation over (ends, rows); twenty numbers a task reach the driver."""
    model = BreakModel()
    for _ in range(rounds):
        now = (model.signs, model.trans)

        def step(batches: Iterator[pd.DataFrame], now: tuple = now) -> Iterator[pd.DataFrame]:
            m, emit, trans = BreakModel(*now), np.zeros((2, 8)), np.zeros((2, 2))
            for pdf in batches:
                order = pdf["ends"].str.len().to_numpy().argsort(kind="stable")
                for at in range(0, len(order), 2000):
                    part = pdf.iloc[order[at : at + 2000]]
                    marg, pair, digits, mask = m.marginals(part["ends"].tolist())
                    n = part["rows"].to_numpy(float)[:, None] * mask
                    emit[1] += np.bincount(digits[mask], weights=(marg * n)[mask], minlength=8)
                    emit[0] += np.bincount(digits[mask], weights=((1 - marg) * n)[mask], minlength=8)
                    trans += pair * part["rows"].mean()
            yield pd.DataFrame({"place": range(20), "n": [*emit.ravel(), *trans.ravel()]})

        got = ends.mapInPandas(step, "place int, n double").groupBy("place").agg(F.sum("n").alias("n")).collect()
        flat = np.zeros(20)
        for r in got:
            flat[r["place"]] = r["n"]
        met, trans = flat[:16].reshape(2, 8), flat[16:].reshape(2, 2) + np.array([[8, 2], [9.5, 0.5]])
        weight = 20 + 0.05 * met.sum(axis=1, keepdims=True)  # a twentieth of the belief stays
        signs = (met @ _BITS + weight * BreakModel.PRIOR) / (met.sum(axis=1, keepdims=True) + weight)
        model = BreakModel(signs, trans / trans.sum(axis=1, keepdims=True))
    return model


# --- the hidden Markov model -------------------------------------------------


def _bins(coded: str) -> list[int]:
    return [int(x) for x in coded.split(",")] if coded else []


class LineModel:
    """Transition, layout and word probabilities of the three line states."""

    def __init__(self, trans: np.ndarray | None = None, layout: dict[str, np.ndarray] | None = None, words: np.ndarray | None = None):
        self.trans = trans if trans is not None else np.full((4, 3), 1 / 3)
        self.layout = layout if layout is not None else {}  # symbol -> its chance in each state
        self.words = words
        self.emit = lru_cache(maxsize=200_000)(self._emit)

    @staticmethod
    def prior(symbol: str) -> np.ndarray:
        """Starting belief in (body, header, page number) for a line of these features; a broken word speaks for body."""
        shape, know, place, flaw = _features(symbol)
        if shape == "n":  # a bare number is no title
            return np.array([0.03, 0.0, 0.97]) if know < 3 else np.array([0.7, 0.0, 0.3])
        if know >= 3:  # what the annotators wrote too is text by definition
            return np.array([1.0, 0.0, 0.0])
        if know == 2:
            p = np.array([0.9, 0.1, 0.0])
        else:
            p = np.array([0.25, 0.75, 0.0]) if place in "fs" else np.array([0.75, 0.25, 0.0])
        p = p * ([1.0, 0.3, 1.0] if flaw & 1 else 1.0)
        return p / p.sum()

    def _emit(self, symbol: str, bins: str) -> np.ndarray:
        p = np.log((self.layout[symbol] if symbol in self.layout else self.prior(symbol)) + 1e-12)
        if bins and self.words is not None:
            p = p + np.clip(self.words[:, _bins(bins)].sum(axis=1), -40, 40)
        return p

    def posteriors(self, symbols: str, bins: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward: state probabilities per line and expected transitions."""
        e = np.exp(np.array([self.emit(s, b) for s, b in zip(symbols, bins)]).clip(-90, 60))
        n = len(symbols)
        fwd, bwd = np.zeros((n, 3)), np.ones((n, 3))
        fwd[0] = self.trans[3] * e[0]
        fwd[0] /= fwd[0].sum()
        for i in range(1, n):
            fwd[i] = fwd[i - 1] @ self.trans[:3] * e[i]
            fwd[i] /= fwd[i].sum()
        for i in range(n - 2, -1, -1):
            bwd[i] = self.trans[:3] @ (e[i + 1] * bwd[i + 1])
            bwd[i] /= bwd[i].sum()
        gamma = fwd * bwd
        gamma /= gamma.sum(axis=1, keepdims=True)
        xi = np.zeros((4, 3))
        xi[3] = gamma[0]
        for i in range(n - 1):
            x = fwd[i][:, None] * self.trans[:3] * (e[i + 1] * bwd[i + 1])[None, :]
            xi[:3] += x / x.sum()
        return gamma, xi

    def states(self, symbols: str, bins: list[str]) -> list[int]:
        return self.posteriors(symbols, bins)[0].argmax(axis=1).tolist() if symbols else []


def fit(parts: DataFrame, layouts: DataFrame, rounds: int = ROUNDS) -> LineModel:
    """Expectation-maximisation over the (part, part_bins, rows) that hold a line in doubt.

    What sure lines add is counted once, from (symbols, rows). Sums of a size fixed by the model reach
    the driver. The first round takes the prior belief for the posterior. Words enter as log-ratios of
    their bin's frequency in the state against body text.
    """
    fixed_trans, fixed_layout = np.zeros((4, 3)), {}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, float] = {}
        for pdf in batches:
            for symbols, rows in zip(pdf["symbols"], pdf["rows"]):
                kept = set(uncertain_part(symbols, [""] * len(symbols))[2])
                for i, x in enumerate(symbols):
                    if i not in kept:
                        total[x] = total.get(x, 0) + rows
                        step = "^" if not i else "-"
                        total[step] = total.get(step, 0) + rows
        yield pd.DataFrame(list(total.items()), columns=["part", "n"])

    for r in layouts.mapInPandas(count, "part string, n double").groupBy("part").agg(F.sum("n").alias("n")).collect():
        if r["part"] in "^-":
            fixed_trans[3 if r["part"] == "^" else BODY, BODY] += r["n"]
        else:
            fixed_layout[r["part"]] = r["n"]
    model = LineModel()
    for _ in range(rounds):
        now = (model.trans, model.layout, model.words)

        def step(batches: Iterator[pd.DataFrame], now: tuple = now) -> Iterator[pd.DataFrame]:
            m = LineModel(*now)
            trans = np.zeros((4, 3))
            layout: dict[str, np.ndarray] = {}
            words = np.zeros((3, WORD_BINS))
            for pdf in batches:
                for symbols, bins, rows in zip(pdf["part"], pdf["part_bins"], pdf["rows"]):
                    gamma, xi = m.posteriors(symbols, bins)
                    trans += xi * rows
                    for s, b, g in zip(symbols, bins, gamma):
                        layout[s] = layout.get(s, 0) + g * rows
                        for x in _bins(b):
                            words[:, x] += g * rows
            out = [(f"t{i}", *trans[i]) for i in range(4)] + [(f"s{s}", *v) for s, v in layout.items()]
            out += [(f"w{x}", *words[:, x]) for x in np.flatnonzero(words.sum(axis=0))]
            yield pd.DataFrame(out, columns=["part", "a", "b", "c"])

        sums = parts.mapInPandas(step, "part string, a double, b double, c double").groupBy("part").agg(*[F.sum(x).alias(x) for x in "abc"]).collect()
        trans, words = fixed_trans + 0.5, np.zeros((3, WORD_BINS))
        layout = {x: np.array([n, 0.0, 0.0]) for x, n in fixed_layout.items()}
        for r in sums:
            v = np.array([r["a"], r["b"], r["c"]])
            if r["part"][0] == "t":
                trans[int(r["part"][1:])] += v
            elif r["part"][0] == "s":
                s = r["part"][1:]
                layout[s] = layout.get(s, 0) + v + min(v.sum(), 20) * LineModel.prior(s)
            else:
                words[:, int(r["part"][1:])] = v
        total = sum(layout.values(), np.zeros(3)) + 1
        layout = {s: (v + 0.01) * (LineModel.prior(s) > 0) / total for s, v in layout.items()}
        per = words.sum(axis=1, keepdims=True) + 0.5 * 400
        logs = np.log((words + 0.5) / per)
        model = LineModel(trans / trans.sum(axis=1, keepdims=True), layout, (logs - logs[0]).clip(-3, 3))
    return model


def lines_beside(text: str, spans: list[tuple[int, int, str | None]], form: Form) -> tuple[str, frozenset[str]]:
    """The text with its lines in the consistent form but for those that a garbled stretch touches, and these lines."""
    out, left, at = [], set(), 0
    for line in text.split("\n"):
        end = at + len(line)
        if any(a < end and b > at for a, b, _ in spans):
            left.add(line)
        else:
            line = form.apply(line)
        out.append(line)
        at = end + 1
    return "\n".join(out), frozenset(left)


# --- the operator ------------------------------------------------------------


class ScanNoise:
    """Recognised rows with their lines labelled.

    Rows of sources starting with ``prefix`` are the annotators' and serve as the page's reference,
    all of them. Garbled texts and texts cut before the page's end
    have a readable form (garbled lines stay as they are) but no noise to report and no part in the
    training; with ``keep`` off they are left out, as are null and empty ones always. A page without annotators has no reference; its
    lines are judged by layout and words alone.
    """

    def __init__(self, df: DataFrame, key: str = "row_id", page: str = "page_id", source: str = "system", text: str = "text", prefix: str = "gt_", rounds: int = ROUNDS, keep: bool = True):
        self.key, self.keep = key, keep
        slim = df.select(F.col(key).alias("_key"), F.col(page).cast("string").alias("_page"), F.col(source).cast("string").alias("_source"), F.col(text).cast("string").alias("_text"))
        slim = slim.where(F.col("_text").isNotNull() & (F.col("_text") != ""))
        self.kind = dict(slim.dtypes)["_key"]
        human = F.coalesce(F.col("_source").startswith(prefix), F.lit(False))
        rows, refs = slim.where(~human), slim.where(human & F.col("_page").isNotNull())
        crowd = F.broadcast(checkpoint(hot_keys(refs, "_page", CROWD)))
        few = refs.join(crowd, "_page", "left_anti").groupBy("_page").agg(F.array_sort(F.collect_set("_text")).alias("texts"))
        plain = rows.join(crowd, "_page", "left_anti")
        read = self._read(salted_join(plain, few, "_page", hot_keys(plain, "_page"), "_key"))
        crowded = self._read_crowded(rows.join(crowd, "_page", "left_semi"), self._known(refs.join(crowd, "_page")))
        self.read = checkpoint(read.unionByName(crowded))
        parts = self.read.where("state is null and part != ''").groupBy("part", "part_bins").agg(F.count("*").alias("rows"))
        layouts = self.read.where("state is null").groupBy("symbols").agg(F.count("*").alias("rows"))
        self.model = fit(checkpoint(parts), checkpoint(layouts), rounds)

    @staticmethod
    def _known(refs: DataFrame) -> DataFrame:
        """(_page, known): what the annotators of crowded pages wrote, put together from salted parts."""

        def collect(pdf: pd.DataFrame) -> pd.DataFrame:
            known = Known()
            known.add(pdf["_text"], Form())
            return pd.DataFrame({"_page": pdf["_page"].iloc[:1], "known": [known.dumps()]})

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            known = Known()
            for raw in pdf["known"]:
                known.merge(Known.loads(raw))
            return pd.DataFrame({"_page": pdf["_page"].iloc[:1], "known": [known.dumps()]})

        salts = F.ceil(F.col("_salts") * CROWD / ROWS_PER_SALT)
        texts = refs.select("_page", "_text", F.pmod(F.xxhash64("_text"), salts).alias("_salt")).distinct()
        parts = spread(texts, "_page", "_salt").groupBy("_page", "_salt").applyInPandas(collect, "_page string, known binary")
        return parts.groupBy("_page").applyInPandas(merge, "_page string, known binary")

    def _schema(self) -> str:
        return (
            f"_key {self.kind}, symbols string, part string, part_bins array<string>, keep array<int>, lines array<string>, joins array<string>, misread array<string>, beside array<boolean>, state string, ends string"
        )

    def _reader(self):
        """A function from (keys, texts, pages) to a frame of what the texts' lines look like."""
        keep, names = self.keep, [x.strip().split(" ")[0] for x in self._schema().split(",")]

        def scan(rows: Iterable[tuple], form: Form) -> pd.DataFrame:
            out = []
            for k, t, page in rows:
                spans, left, state = mojibake.garbled(t), frozenset(), None
                if spans:
                    if not keep:
                        continue
                    t, left = lines_beside(t, spans, form)
                    state = "garbled" if any(x not in left for x in lines_of(t)) else "unread"
                else:
                    t = form.apply(t)
                symbols, bins, lines, tail = read_lines(t, page, left)
                ends = line_ends(t) if keep else None
                end = " ".join(tail)
                if not spans and page.tails and end not in page.tails and all(verdict(end, x) > 0 for x in page.tails):
                    if not keep:
                        continue
                    state = "cut"  # whichever annotator is followed
                coded = [",".join(map(str, x)) for x in bins]
                misread = [json.dumps(x[2]) if x[2] else "" for x in lines]
                out.append((k, symbols, *uncertain_part(symbols, coded), [x[0] for x in lines] if keep else [], [x[1] for x in lines], misread, [x[3] for x in lines], state, ends))
            return pd.DataFrame(out, columns=names)

        return scan

    def _read(self, joined: DataFrame) -> DataFrame:
        read = self._reader()

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            form = Form()
            page_of = lru_cache(maxsize=64)(lambda texts: Page(texts, form))
            for pdf in batches:
                pages = (page_of(() if x is None else tuple(x)) for x in pdf["texts"])
                yield read(zip(pdf["_key"].tolist(), pdf["_text"].tolist(), pages), form)

        return joined.mapInPandas(scan, self._schema())

    def _read_crowded(self, rows: DataFrame, known: DataFrame) -> DataFrame:
        """The same for rows of crowded pages: each task is handed the page's reference once, not with every row."""
        read = self._reader()
        salts = F.broadcast(checkpoint(hot_keys(rows, "_page", ROWS_PER_SALT)))
        salt = F.pmod(F.xxhash64("_key"), F.coalesce("_salts", F.lit(1)))
        left = rows.join(salts, "_page", "left").select("_page", salt.cast("int").alias("_salt"), "_key", "_text")
        each = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
        right = known.join(salts, "_page", "left").select("_page", each.alias("_salt"), "known")

        def scan(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            form = Form()
            page = Page((), form, Known.loads(b["known"].iloc[0]) if len(b) else None)
            return read(((k, t, page) for k, t in zip(a["_key"].tolist(), a["_text"].tolist())), form)

        pairs = spread(left, "_page", "_salt").groupBy("_page", "_salt").cogroup(right.groupBy("_page", "_salt"))
        return pairs.applyInPandas(scan, self._schema())

    def _labelled(self, schema: str, build) -> DataFrame:
        now = (self.model.trans, self.model.layout, self.model.words)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = LineModel(*now)
            decode = lru_cache(maxsize=50_000)(lambda part, bins: m.states(part, list(bins)))
            for pdf in batches:
                out = []
                for r in pdf.itertuples(index=False):
                    states = [BODY] * len(r.symbols)
                    if r.part:
                        for i, x in zip(r.keep, decode(r.part, tuple(r.part_bins))):
                            states[i] = x
                    out += build(r, states)
                yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in schema.split(",")])

        return self.read.withColumnRenamed("_key", "key").mapInPandas(scan, schema).withColumnRenamed("key", self.key)

    def found(self) -> DataFrame:
        """(key, kind): the kinds of noise in each row."""

        def build(r, states: list[int]) -> list[tuple]:
            kinds = set()
            if r.state is not None:
                return []
            for s, join, misread, beside in zip(states, r.joins, r.misread, r.beside):
                if s == HEADER:
                    kinds.add("header")
                    if beside:
                        kinds.add("pageno")
                elif s == FOLIO:
                    kinds.add("pageno")
                else:
                    if join is not None:
                        kinds.add("hyphen")
                    if misread:
                        kinds.add("char")
            return [(r.key, k) for k in KINDS if k in kinds]

        return self._labelled(f"key {self.kind}, kind string", build)

    def paragraphs(self, unread: bool = False) -> DataFrame:
        """(key, repaired, state): the running text, one paragraph up to each line end labelled as a break.

        ``state`` is null, ``cut`` or ``garbled`` (garbled lines are as they were). A text all of whose lines
        are garbled has no readable form; with ``unread`` it comes too, its lines unchanged, as ``unread``.
        """

        ends = self.read.where("state is null and ends != ''").groupBy("ends").agg(F.count("*").alias("rows"))
        model = fit_breaks(checkpoint(ends))

        def build(r, states: list[int]) -> list[tuple]:
            if r.state == "unread":
                return [(r.key, "\n".join(r.lines), r.state)] if unread else []
            out, carry = [], ""
            body = [x for x, s in zip(zip(r.lines, r.joins, r.misread, model.breaks(r.ends)), states) if s == BODY]
            for line, join, misread, ends_here in body:
                words = _LINE_NO.sub("", line).split()
                fix = {a: b for a, b in json.loads(misread or "{}").items() if b != "�"}
                words = [fix.get(w, w) for w in words]
                if carry and words:
                    words[0] = carry + words[0]
                    carry = ""
                if join is not None and words:
                    while len(words) > 1 and not words[-1].strip(_BREAK_SIGNS):
                        words.pop()
                    carry = words.pop().rstrip(_BREAK_SIGNS)
                text = " ".join(words)
                out.append(text + ("\n\n" if ends_here and join is None else " ") if text else "")
            return [(r.key, re.sub(r" +\n", "\n", "".join(out) + carry).strip(), r.state)]

        return self._labelled(f"key {self.kind}, repaired string, state string", build)
