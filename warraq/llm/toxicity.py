"""Abusive, hateful and sexually explicit passages in documents.

A linear-chain conditional random field tags toxic tokens. It starts from hand-labelled sentences of
everyday language and learns the corpus's own from a bounded number of reviewed documents: sentences of
those found in order are harmless, and in those found toxic the passage is looked for that earned the
verdict. Words are
first brought to one spelling (case, invisible characters, spaced and dotted letters, digits for
letters, drawn-out letters, masked letters). Forward-backward marginals give each passage a
probability; a document's score is that of its worst passage.
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

from warraq.llm.chains import forward_backward
from warraq.llm.chars import INVISIBLE, TO_LATIN
from warraq.llm.toxic_seed import sentences
from warraq.session import checkpoint

#: Reviewed documents of either verdict, and distinct harmless sentences of theirs, that the training takes at most.
MOST_REVIEWED = 4000
MOST_SENTENCES = 6000
#: How likely a reviewed document is toxic, at most to count as harmless and at least to count as toxic.
HARMLESS_BELOW, TOXIC_FROM = 0.05, 0.8
THRESHOLD = 0.8
BITS = 18

_HIDE = re.compile(f"[{INVISIBLE}]+")
_TOKEN = re.compile(r"[^\W_]+(?:[*@$'’._•-]+[^\W_]+)*|[@$][\w@$]+|[^\W_]+\*+")
_SPLIT = re.compile(r"(?<=[.!?؟])[ \t\r]+|\n+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_] ){2,}[^\W\d_]{1,2}(?![^\W_])|(?<![^\W_])(?:[^\W\d_][.\-_*•]){2,}[^\W\d_](?![^\W_])")
_REPEAT = re.compile(r"(.)\1{2,}")
_MARKS = re.compile("[ـً-ٰٟ]")
_DIGITS = re.compile(r"\d+")
#: Whole tokens of digits: no letter, and no sign that a spelling may use, is beside them.
_NUMBER = re.compile(rf"(?<![\w*@$'’.•\-{INVISIBLE}])\d+(?:[.'’•-]+\d+)*(?![\w*@$'’•\-{INVISIBLE}]|\.+[\w*@$'’•\-{INVISIBLE}])")
_LEET = str.maketrans("013457@$!", "oieastasi")
_LEET_L = str.maketrans("013457@$!", "oleastasl")
_FOLD = str.maketrans("آأإٱىئؤة", "اااايييه"[:7] + "ه")


def plain(token: str) -> str:
    """A token in lower case without marks, with letters folded as far as spelling habits differ."""
    t = unicodedata.normalize("NFKC", token).replace("İ", "i").lower()
    if not t.isascii():
        t = _MARKS.sub("", t).translate(_FOLD)
        t = "".join(TO_LATIN.get(c, c) for c in t)
    return t


def numberless(text: str) -> str:
    """The text with 0 for every number, which reads the same; digits within words stand for letters and stay."""
    return _NUMBER.sub(lambda m: _DIGITS.sub("0", m.group()), text) if _DIGITS.search(text) else text


class Vocabulary:
    """Known words, and how disguised spellings lead back to them."""

    def __init__(self, words: dict[str, int], toxic: set[str]):
        self.words = words
        self.toxic = toxic
        self.by_shape: dict[tuple[str, int], list[str]] = {}
        for w in sorted(toxic):
            self.by_shape.setdefault((w[0], len(w)), []).append(w)
        self.read = lru_cache(maxsize=200_000)(self._read)

    def _known(self, t: str) -> str | None:
        if t in self.words:
            return t
        for cut in ("s", "es", "n", "en", "e"):
            if t.endswith(cut) and t[: -len(cut)] in self.toxic:
                return t[: -len(cut)]
        return None

    def _read(self, token: str) -> str:
        """The known word that a token spells, else the token in plain form ('#' for a number)."""
        t = plain(token)
        if t in self.words:
            return t
        if t[:1].isdigit() and re.sub(r"[.\-_*•'’]", "", t).isdigit():
            return "#"
        if t.isalpha() and not _REPEAT.search(t):
            return self._known(t) or t
        if "*" in t and len(t) > 2:
            head = t[0]
            pattern = re.compile("".join("." if c == "*" else re.escape(c) for c in t))
            for n in (len(t), len(t) - 1):
                for w in self.by_shape.get((head, n), ()):
                    if pattern.fullmatch(w if n == len(t) else w + "s"):
                        return w
        tries = [t]
        bare = re.sub(r"[.\-_*•'’]", "", t)
        tries += [bare, bare.translate(_LEET), bare.translate(_LEET_L), t.translate(_LEET), t.translate(_LEET_L)]
        tries += [_REPEAT.sub(r"\1", x) for x in tries] + [_REPEAT.sub(r"\1\1", x) for x in tries]
        for x in tries:
            if x and (hit := self._known(x)):
                return hit
        if any(c.isdigit() or c in "@$*" for c in t) and any(c.isalpha() for c in t):
            return "~"  # letters mixed with signs: a disguise, or a shelf mark
        return bare or t

    def tokens(self, sentence: str) -> list[str]:
        s = _HIDE.sub("", sentence)
        if _SPACED.search(s):
            s = _SPACED.sub(self._join, s)
        return [self.read(x) for x in _TOKEN.findall(s)]

    def _join(self, m: re.Match) -> str:
        letters = re.split(r"[ .\-_*•]", m.group())
        for end in (len(letters), len(letters) - 1):  # a short word may follow the spaced one
            t = "".join(letters[:end])
            if self._known(plain(t)):
                return " ".join([t, *letters[end:]])
        return m.group()


# --- the conditional random field -------------------------------------------


def _hash(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    x = (a.astype(np.uint64) * np.uint64(0x9E3779B1) + b.astype(np.uint64) * np.uint64(0x85EBCA77) + np.uint64(salt)) & np.uint64(0xFFFFFFFF)
    x ^= x >> np.uint64(15)
    x = (x * np.uint64(0x2C1B3C6D)) & np.uint64(0xFFFFFFFF)
    return ((x ^ (x >> np.uint64(12))) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def features(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Feature numbers of each token of a batch (one row a token): itself, its neighbours, the pairs with them."""
    n = len(ids)
    prev, nxt = np.concatenate([[1], ids[:-1]]), np.concatenate([ids[1:], [1]])
    prev2, nxt2 = np.concatenate([[1, 1], ids[:-2]])[:n], np.concatenate([ids[2:], [1, 1]])[:n]
    first = starts.copy()
    last = np.concatenate([starts[1:], [True]])
    prev = np.where(first, 1, prev)
    nxt = np.where(last, 1, nxt)
    prev2 = np.where(first | np.concatenate([[True], first[:-1]])[:n], 1, prev2)
    nxt2 = np.where(last | np.concatenate([last[1:], [True]])[:n], 1, nxt2)
    zero = np.zeros(n, np.int64)
    return np.stack([_hash(zero, zero, 9), _hash(ids, zero, 1), _hash(prev, zero, 2), _hash(nxt, zero, 3), _hash(prev, ids, 4), _hash(ids, nxt, 5), _hash(prev2, prev, 6), _hash(nxt, nxt2, 7)], axis=1)


class Tagger:
    """Binary linear-chain CRF: a weight per feature for 'toxic', and transition weights."""

    def __init__(self, words: dict[str, int], toxic: set[str], weights: np.ndarray, trans: np.ndarray):
        self.vocabulary = Vocabulary(words, toxic)
        self.weights, self.trans = weights, trans

    def ids(self, tokens: list[str]) -> list[int]:
        get = self.vocabulary.words.get
        return [get(t, 2) for t in tokens]  # 2 stands for any unknown word

    def marginals(self, batch: list[list[int]]) -> list[np.ndarray]:
        """Probability of being toxic for each token of each sentence."""
        if not batch:
            return []
        lengths = np.array([len(x) for x in batch])
        flat = np.fromiter((i for x in batch for i in x), np.int64, lengths.sum())
        starts = np.zeros(len(flat), bool)
        at = np.concatenate([[0], np.cumsum(lengths)])
        starts[at[:-1]] = True
        emit = self.weights[features(flat, starts)].sum(axis=1)
        out: list[np.ndarray] = [np.zeros(0)] * len(batch)
        # A sentence's odds of holding any toxic token are at most exp(sum of positive weights) times the
        # number of passages and the best transitions; sentences that cannot come near are settled by that.
        bound = np.add.reduceat(np.maximum(emit, 0), at[:-1]) + 2 * np.log(lengths + 1) + max(0.0, self.trans[0, 1] - self.trans[0, 0]) + max(0.0, self.trans[1, 0] - self.trans[0, 0]) + np.maximum(0, self.trans[1, 1] - self.trans[0, 0]) * lengths
        open_ = np.flatnonzero(bound > -4)
        for i in np.flatnonzero(bound <= -4):
            out[i] = np.zeros(lengths[i])
        order = open_[np.argsort(lengths[open_], kind="stable")]
        for k in range(0, len(order), 512):
            part = order[k : k + 512]
            width = lengths[part].max()
            e = np.zeros((len(part), width))
            mask = np.arange(width) < lengths[part][:, None]
            e[mask] = np.concatenate([emit[at[i] : at[i + 1]] for i in part])
            m, _ = forward_backward(e, mask, self.trans)
            for row, i in enumerate(part):
                out[i] = m[row, : lengths[i]]
        return out


Labelled = list[tuple[list[str], list[bool]]]


def tokenized(labelled: list[list[tuple[str, bool]]]) -> Labelled:
    """Tokens with their labels, of sentences in labelled parts."""
    raw = Vocabulary({}, set())
    out = []
    for parts in labelled:
        toks, labs = [], []
        for text, label in parts:
            w = raw.tokens(text)
            toks += w
            labs += [label] * len(w)
        out.append((toks, labs))
    return out


def train(labelled: list[list[tuple[str, bool]]], **options) -> Tagger:
    return train_tokens(tokenized(labelled), **options)


def train_tokens(data: Labelled, reviewed: Labelled = (), rounds: int = 14, l2: float = 0.0002, seed: int = 3) -> Tagger:
    """Maximum likelihood by Adam over shuffled batches of labelled sentences.

    Words of ``data`` (not of ``reviewed``) that occur once count as unknown ones: they are invented names.
    """
    toxic_count: dict[str, int] = {}
    clean_count: dict[str, int] = {}
    for toks, labs in (*data, *reviewed):
        for w, y in zip(toks, labs):
            d = toxic_count if y else clean_count
            d[w] = d.get(w, 0) + 1
    kept = {w for toks, _ in reviewed for w in toks} | {"#", "~"}
    both = set(toxic_count) | set(clean_count)
    words = {w: i + 10 for i, w in enumerate(sorted(kept | {w for w in both if toxic_count.get(w, 0) + clean_count.get(w, 0) > 1}))}
    toxic = {w for w, n in toxic_count.items() if w in words and len(w) > 1 and w.isalpha() and n > 2 * clean_count.get(w, 0)}
    rng = np.random.default_rng(seed)
    coded = [(np.array([words.get(w, 2) for w in toks]), np.array(labs, float)) for toks, labs in (*data, *reviewed) if toks]
    # Running text: unknown words, and unknown words among common harmless ones.
    common = np.array([words[w] for w in sorted(clean_count, key=lambda w: (-clean_count[w], w)) if w in words and w not in toxic][:400])
    for n in rng.integers(1, 13, 1200):
        ids = np.where(rng.random(n) < rng.choice([0.5, 0.8, 1.0]), 2, rng.choice(common, n)) if len(common) else np.full(n, 2)
        coded.append((ids, np.zeros(n)))
    tagger = Tagger(words, toxic, np.zeros(1 << BITS), np.array([[1.5, -2.0], [-2.0, 1.5]]))
    weights, trans = tagger.weights, tagger.trans
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    mt, vt = np.zeros((2, 2)), np.zeros((2, 2))
    step = 0
    for epoch in range(rounds):
        # Like lengths go together; batches come in random order.
        lengths = np.array([len(x) for x, _ in coded]) + rng.random(len(coded)) * 3
        order = np.argsort(lengths)
        rate = 0.12 * (1 - epoch / rounds) + 0.004
        for k in rng.permutation(range(0, len(order), 256)):
            part = [coded[i] for i in order[k : k + 256]]
            # Words are hidden from the model now and then. Running text of words it doesn't know is
            # harmless unless the known ones say otherwise, so harmless sentences lose more of them.
            hide = np.where([y.any() for _, y in part], 0.08, rng.choice([0.0, 0.1, 0.5, 0.9, 1.0], len(part)))
            size = np.array([len(x) for x, _ in part])
            flat = np.concatenate([x for x, _ in part])
            flat = np.where(rng.random(len(flat)) < np.repeat(hide, size), 2, flat)
            gold_flat = np.concatenate([y for _, y in part])
            starts = np.zeros(len(flat), bool)
            starts[np.concatenate([[0], np.cumsum(size)])[:-1]] = True
            feats = features(flat, starts)
            mask = np.arange(size.max()) < size[:, None]
            e, gold = np.zeros(mask.shape), np.zeros(mask.shape)
            e[mask] = weights[feats].sum(axis=1)
            gold[mask] = gold_flat
            marg, pair = forward_backward(e, mask, trans)
            at, place = np.unique(feats, return_inverse=True)
            g = np.bincount(place.ravel(), weights=np.repeat((marg - gold)[mask], feats.shape[1]), minlength=len(at)) / len(part) + l2 * weights[at]
            inner = mask[:, 1:] & mask[:, :-1]
            seen = np.array([[((gold[:, :-1] == x) & (gold[:, 1:] == y) & inner).sum() for y in (0, 1)] for x in (0, 1)])
            gt = (pair - seen) / len(part) + 0.01 * trans
            step += 1
            # Moments of a weight move when it is met, so that a step costs what its batch holds.
            m[at] = 0.9 * m[at] + 0.1 * g
            v[at] = 0.99 * v[at] + 0.01 * g * g
            weights[at] -= rate * m[at] / (np.sqrt(v[at]) + 1e-4)
            mt, vt = 0.9 * mt + 0.1 * gt, 0.99 * vt + 0.01 * gt * gt
            trans -= 0.3 * rate * (mt / (1 - 0.9**step)) / (np.sqrt(vt / (1 - 0.99**step)) + 1e-6)
    return tagger


def passage_score(marginals: np.ndarray) -> tuple[float, int, int]:
    """Probability of the likeliest passage and its first and last token: the mean marginal over the run
    of tokens that are more likely toxic than not (the highest marginal if there is none)."""
    if not len(marginals):
        return 0.0, 0, 0
    on = marginals > 0.5
    if not on.any():
        i = int(marginals.argmax())
        return float(marginals[i]), i, i + 1
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    runs = [(float(marginals[a:b].mean()) * (1.0 if b - a > 1 else 0.9), a, b) for a, b in zip(edges[::2], edges[1::2])]
    s, a, b = max(runs)
    return s, int(a), int(b)


# --- the operator ------------------------------------------------------------


def judged(reviews: DataFrame, rounds: int = 3) -> DataFrame:
    """(doc_id, p): how likely a reviewed document is toxic, given how careful its reviewers are.

    Expectation-maximisation over the reviewers' rates of calling toxic and harmless documents toxic; verdicts
    other than the four and ``unsure`` count for nothing, repeated ones once. Each round aggregates by document
    and by reviewer.
    """
    votes = reviews.where("doc_id is not null and verdict in ('ok', 'abusive', 'hateful', 'sexual')")
    votes = votes.select("doc_id", F.coalesce("reviewer", F.lit("")).alias("reviewer"), (F.col("verdict") != "ok").cast("double").alias("bad")).groupBy("doc_id", "reviewer").agg(F.max("bad").alias("bad"))
    votes = checkpoint(votes)
    lead = F.sum("bad") * 2 - F.count("*")
    p = votes.groupBy("doc_id").agg(F.when(lead > 0, 0.9).when(lead == 0, 0.4).otherwise(0.03).alias("p"))
    for _ in range(rounds):
        w = votes.join(p, "doc_id").groupBy("reviewer").agg(
            ((F.sum(F.col("p") * F.col("bad")) + 4.5) / (F.sum("p") + 5)).alias("hit"), ((F.sum((1 - F.col("p")) * F.col("bad")) + 0.5) / (F.sum(1 - F.col("p")) + 5)).alias("false")
        )
        share = min(0.5, max(0.001, p.agg(F.avg("p").alias("p")).first()["p"] or 0.5))
        odds = F.when(F.col("bad") > 0, F.log(F.col("hit") / F.col("false"))).otherwise(F.log((1 - F.col("hit")) / (1 - F.col("false"))))
        p = checkpoint(votes.join(w, "reviewer").groupBy("doc_id").agg((1 / (1 + F.exp(-F.sum(odds) - math.log(share / (1 - share))))).alias("p")))
    return p


def reviewed(documents: DataFrame, reviews: DataFrame, most: int = MOST_REVIEWED) -> tuple[list[str], list[str]]:
    """Texts (of at most 20,000 characters) that reviewers surely found in order, and that they surely found toxic.

    At most ``most`` of either, drawn by a hash of the id.
    """
    p = judged(reviews)
    texts = documents.select("doc_id", "text").where("text is not null and length(text) <= 20000").groupBy("doc_id").agg(F.min("text").alias("text"))
    out = []
    for kind in (F.col("p") <= HARMLESS_BELOW, F.col("p") >= TOXIC_FROM):
        drawn = p.where(kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id")
        out.append(sorted(r["text"] for r in texts.join(F.broadcast(drawn), "doc_id", "left_semi").collect()))
    return out[0], out[1]


def _sentences(text: str) -> list[str]:
    return [s.strip() for s in _SPLIT.split(numberless(text)) if s.strip()]


def _pairs(tokens: list[str]) -> list[tuple[str, str]]:
    return list(zip(["", *tokens], [*tokens, ""]))


class Passages:
    """Which sentences of reviewed documents earned the verdict (learning from bags of sentences).

    Harmless sentences repeat pairs of words that documents in order hold; a passage's pairs are foreign to
    them. Of the sentences made of foreign pairs those count that the tagger calls toxic, or whose pairs other
    toxic documents share (running text of rare words shares none).
    """

    def __init__(self, clean: list[str], toxic: list[str], tagger: Tagger, most: int = MOST_SENTENCES):
        self.seed = tagger.vocabulary.words
        self.most, self.sizes = most, (len(clean), len(toxic))
        read = tagger.vocabulary.tokens
        self.in_order: dict[tuple[str, str], int] = {}
        documents: dict[str, int] = {}
        self.in_toxic: dict[tuple[str, str], int] = {}
        seen: dict[str, list[str]] = {}
        for text in clean:
            held = set()
            for s in dict.fromkeys(_sentences(text)):
                if s not in seen:
                    seen[s] = read(s)
                documents[s] = documents.get(s, 0) + 1
                held.update(_pairs(seen[s]))
            for p in held:
                self.in_order[p] = self.in_order.get(p, 0) + 1
        self.bags = [[t for s in dict.fromkeys(_sentences(text)) if (t := read(s))] for text in toxic]
        self.words: dict[str, int] = {}
        for bag in self.bags:
            for p in {p for t in bag for p in _pairs(t)}:
                self.in_toxic[p] = self.in_toxic.get(p, 0) + 1
            for w in {w for t in bag for w in t}:
                self.words[w] = self.words.get(w, 0) + 1
        # Sentences of documents in order that look like a passage stay out: some reviewers are careless.
        harmless = [s for s, t in seen.items() if t and sum(self._shared(p) and self.in_order[p] < 3 for p in _pairs(t)) < max(2, len(t) / 2)]
        harmless.sort(key=lambda s: (-documents[s], zlib.crc32(s.encode("utf-8", "surrogatepass")), s))  # repeated ones first
        self._harmless: Labelled = [(seen[s], [False] * len(seen[s])) for s in harmless]
        self._once = [documents[s] == 1 for s in harmless]

    def harmless(self, tagger: Tagger | None = None, near: float = 0.3, sure: float = 0.8) -> Labelled:
        """At most ``most`` harmless sentences, and a quarter more of those left over that the tagger comes near to calling toxic.

        One document's own sentence that the tagger surely calls toxic is left out: its reviewer was careless.
        """
        if tagger is None:
            return self._harmless[: self.most]
        scores = [passage_score(m)[0] for m in tagger.marginals([tagger.ids(t) for t, _ in self._harmless])]
        good = [(x, p) for x, p, once in zip(self._harmless, scores, self._once) if not (once and p >= sure)]
        hard = sorted((-p, i) for i, (_, p) in enumerate(good[self.most :]) if p >= near)
        return [x for x, _ in good[: self.most]] + [good[self.most + i][0] for _, i in hard[: self.most // 4]]

    def _shared(self, pair: tuple[str, str]) -> bool:
        """Do two toxic documents hold the pair and none in order, or three and by rate eight times as many as those in order?"""
        n, harmless = self.in_toxic.get(pair, 0), self.in_order.get(pair, 0)
        return n >= 2 and not harmless or n >= 3 and n * self.sizes[0] > 8 * harmless * self.sizes[1]

    def _foreign(self, pair: tuple[str, str]) -> bool:
        return not self.in_order.get(pair) or self._shared(pair)

    def find(self, tagger: Tagger, sure: float = 0.5) -> Labelled:
        """The passages, labelled where the tagger or shared pairs tell, and over the foreign pairs of known words beside it."""
        out = []
        for bag in self.bags:
            foreign = [[self._foreign(p) for p in _pairs(t)] for t in bag]
            open_ = [i for i, f in enumerate(foreign) if sum(f) * 2 > len(f)]
            marginals = dict(zip(open_, tagger.marginals([tagger.ids(bag[i]) for i in open_])))
            core = {}
            for i, m in marginals.items():
                shared = [self._shared(p) for p in _pairs(bag[i])]
                if passage_score(m)[0] >= sure or sum(shared) >= 3:
                    core[i] = [x > 0.5 or shared[k] and shared[k + 1] for k, x in enumerate(m)]
            if not core and len(open_) == 1:
                core = {open_[0]: [f and g for f, g in zip(foreign[open_[0]], foreign[open_[0]][1:])]}
            for i, on in core.items():
                if not any(on):
                    continue
                t, f = bag[i], foreign[i]
                first, last = on.index(True), len(on) - 1 - on[::-1].index(True)
                while first and f[first] and self.words.get(t[first - 1], 0) > 1:
                    first -= 1
                while last + 1 < len(t) and f[last + 1] and self.words.get(t[last + 1], 0) > 1:
                    last += 1
                # Running text of rare words that sticks to a passage is none of it.
                known = [self.words.get(w, 0) > 1 or w in self.seed for w in t]
                inside = [k for k in range(first, last + 1) if known[k]]
                if inside and sum(known[first : last + 1]) * 3 > last - first:
                    first, last = inside[0], inside[-1]
                elif last - first > 12:
                    continue
                out.append((t, [first <= k <= last and (f[k] or f[k + 1]) for k in range(len(t))]))
        return out


def fit(documents: DataFrame, reviews: DataFrame | None = None, most: int = MOST_REVIEWED) -> Tagger:
    """The tagger, trained on the labelled sentences and on at most ``most`` reviewed documents of either verdict.

    The passages of toxic documents are looked for with the tagger of the labelled sentences, then once more with
    the one that has learned from them.
    """
    seed = tokenized(sentences())
    tagger = train_tokens(seed, rounds=8)
    if reviews is None:
        return train_tokens(seed)
    clean, toxic = reviewed(documents, reviews, most)
    if not clean and not toxic:
        return train_tokens(seed)
    known = Passages(clean, toxic, tagger)
    tagger = train_tokens(seed, known.harmless() + 3 * known.find(tagger), rounds=8)
    return train_tokens(seed, known.harmless(tagger) + 3 * known.find(tagger))


def score(documents: DataFrame, tagger: Tagger, key: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """(key, score[, start, end, passage]) for every document; null and empty texts score 0.

    ``start`` and ``end`` are code point offsets of the worst sentence's toxic tokens.
    """
    slim = documents.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kind = dict(slim.dtypes)["_key"]
    shared = documents.sparkSession.sparkContext.broadcast((tagger.vocabulary.words, tagger.vocabulary.toxic, tagger.weights, tagger.trans))
    schema = f"_key {kind}, score double" + (", start int, end int, passage string" if spans else "")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Tagger(*shared.value)
        known: dict[str, float] = {}
        for pdf in batches:
            texts = pdf["_text"].tolist()
            best = np.zeros(len(texts))
            worst = [""] * len(texts)
            todo: dict[str, list[int]] = {}

            def settle() -> None:
                names = list(todo)
                coded = [t.ids(t.vocabulary.tokens(s)) or [2] for s in names]
                for s, m in zip(names, t.marginals(coded)):
                    p = passage_score(m)[0]
                    if len(s) < 200 and len(known) < 100_000:
                        known[s] = p
                    for i in todo[s]:
                        if p > best[i]:
                            best[i], worst[i] = p, s
                todo.clear()

            for i, x in enumerate(texts):
                if not x:
                    continue
                for s in _SPLIT.split(numberless(x) if not spans else x):
                    p = known.get(s)
                    if p is None:
                        todo.setdefault(s, []).append(i)
                    elif p > best[i]:
                        best[i], worst[i] = p, s
                if len(todo) > 20_000:
                    settle()
            settle()
            out = pd.DataFrame({"_key": pdf["_key"], "score": best})
            if spans:
                found = [locate(t, x, s) if b >= THRESHOLD else (None, None, None) for x, s, b in zip(texts, worst, best)]
                out["start"], out["end"], out["passage"] = (pd.Series([f[k] for f in found], dtype=d) for k, d in enumerate(("Int32", "Int32", object)))
            yield out

    return slim.mapInPandas(scan, schema).withColumnRenamed("_key", key)


def locate(tagger: Tagger, text: str, sentence: str) -> tuple[int, int, str]:
    """Offsets of the toxic tokens of a sentence in the text; of the whole sentence where spellings were joined."""
    at = text.find(sentence)
    tokens = list(_TOKEN.finditer(_HIDE.sub("", sentence)))
    _, a, b = passage_score(tagger.marginals([tagger.ids(tagger.vocabulary.tokens(sentence)) or [2]])[0])
    if _HIDE.search(sentence) or _SPACED.search(sentence) or b > len(tokens):
        return at, at + len(sentence), sentence
    return at + tokens[a].start(), at + tokens[b - 1].end(), sentence[tokens[a].start() : tokens[b - 1].end()]
