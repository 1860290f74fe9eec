"""Consensus, packing, mixing, toxic passages: brute force, invariants, held-out accuracy, edge cases."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from warraq.llm import consensus, mixing, packing, tokens, toxic_seed, toxicity


def frame(spark, rows):
    df = spark.createDataFrame(rows, "row_id long, page_id string, system string, text string")
    for c in ("_key", "_page", "wording", "n", "who"):
        df = df.selectExpr("*", f"'x' as `{c}`")
    return df


# --- consensus ---------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), min_size=1, max_size=8))
def test_edits_rebuild_the_wording(words, pivot):
    edits = dict(consensus.align(words, pivot))
    out = []
    for i in range(len(pivot) + 1):
        out += edits.get(2 * i, "").split()
        if i < len(pivot):
            out += [edits[2 * i + 1]] if 2 * i + 1 in edits and edits[2 * i + 1] else [] if 2 * i + 1 in edits else [pivot[i]]
    assert out == words


def test_consensus_of_simulated_annotators(spark):
    rng = random.Random(1)
    vocab = [a + b for a in "بتثجحخدذ" for b in "رزسشصضطظ"]
    skill = {"gt_a": 0.99, "gt_b": 0.97, "gt_c": 0.9, "gt_d": 0.6}
    rows, truth, wrong, k = [], {}, set(), 0
    for p in range(120):
        page = f"page_{p + 2:02d}"
        t = [rng.choice(vocab) for _ in range(30)]
        truth[page] = " ".join(t)
        for who, s in skill.items():
            w = [x if rng.random() < s else rng.choice(vocab) for x in t]
            if w != t:
                wrong.add(k)
            mark = " ".join(w[:5] + ["[غير واضح]"] + w[6:]) if p % 10 == 0 and who == "gt_a" and w == t else "\n".join([" ".join(w[:15]), " ".join(w[15:])])
            rows.append((k, page, who, "# note\n" + mark))
            k += 1
    c = consensus.Consensus(frame(spark, rows), pooled=("page_01",))
    got = {r["row_id"] for r in c.departing().collect()}
    assert len(got ^ wrong) <= 0.02 * len(wrong)
    text = {r["page_id"]: r["consensus"] for r in c.consensus().collect()}
    assert sum(text[p] == t for p, t in truth.items()) >= 0.97 * len(truth)
    rel = {r["annotator"]: r["competence"] for r in c.reliability().collect()}
    for who, s in skill.items():
        assert abs(rel[who] - s) < 0.03, rel


def test_consensus_edges(spark):
    rows = [(1, "p", "gt_a", "x y"), (2, "p", "gt_b", "x y"), (3, "p", "gt_c", "x z"), (4, "p", "gt_c", "x z"), (5, "p", "kraken", "q"), (6, "q", "gt_a", "a"), (7, "q", "gt_b", "b"), (8, "p", "gt_d", None), (9, "p", "gt_e", ""), (10, None, "gt_a", "x"), (11, "p", None, "x")]
    rows += [(20 + i, "page_01", "gt_a", "m n o" if i % 20 else "m n") for i in range(60)] + [(90, "page_01", "gt_b", "m n o"), (91, "page_01", "gt_c", "m n o o")]
    c = consensus.Consensus(frame(spark, rows), pooled=("page_01",))
    got = {r["row_id"] for r in c.departing().collect()}
    assert got == {3, 4, 91} | {20, 40, 60}  # copies are one voice but each row counts; page q has two annotators
    by = {r["page_id"]: r for r in c.consensus().collect()}
    assert by["p"]["consensus"] == "x y" and by["p"]["voices"] == 3 and by["page_01"]["voices"] == 62
    # word slots: 'x' 1, 'y' one of three pairs
    assert by["p"]["agreement"] == pytest.approx((1 + 1 / 3) / 2)
    empty = consensus.Consensus(frame(spark, []))
    assert empty.departing().count() == 0 and empty.consensus().count() == 0 and empty.reliability().count() == 0


def test_kinds_of_guesses():
    assert [consensus.kind_of(v, "قلم") for v in ("", "قلم", "قدم", "قلما", "كتاب", "ق")] == ["e", "w", "n", "n", "w", "w"] and consensus.kind_of("x", "") == "w"


def test_posterior_against_enumeration():
    """Every value in turn taken for the true one, all labels multiplied up."""
    params = {"a": (0.9, (0.2, 0.1, 0.7)), "b": (0.6, (0.5, 0.3, 0.2)), "c": (0.99, (0.4, 0.3, 0.3))}
    pattern = (("w", (("a", 2.0), ("b", 1.0))), ("e", (("c", 1.0),)), ("n", (("b", 1.0),)), ("w", (("c", 1.0),)))
    labels = {"e": 1, "n": 1 + 10, "w": 2 + 20}
    likes = []
    for t in range(4):
        like = 1.0
        for v, (kind, votes) in enumerate(pattern):
            for who, n in votes:
                c, p = params[who]
                g = (1 - c) * p["enw".index(kind)] / labels[kind]
                like *= (c + g if v == t else g) ** n
        likes.append(like)
    assert consensus.posterior(pattern, params) == pytest.approx([x / sum(likes) for x in likes])


# --- packing -----------------------------------------------------------------------


def test_packing(spark):
    rng = random.Random(2)
    sizes = {i: rng.choice([1, 3, 10, 57, 100, 101, 250, rng.randint(1, 99)]) for i in range(3000)} | {5000: 0}
    df = spark.createDataFrame([(i, n, "x") for i, n in sizes.items()] + [(5001, None, "x")], "doc_id long, tokens long, container string").repartition(9)
    win = spark.createDataFrame([("w", 100), ("v", 1000), ("v", 1000), ("none", 0), (None, 5)], "window_id string, capacity_tokens int")
    out = packing.pack(df, win, most_open=8, fan_in=4)
    rows = out.collect()
    for window, cap in (("w", 100), ("v", 1000)):
        mine = [r for r in rows if r["window_id"] == window]
        room, got = Counter(), defaultdict(list)
        for r in mine:
            room[r["container"]] += r["tokens"]
            got[r["doc_id"]].append((r["piece"], r["start"], r["tokens"]))
        assert max(room.values()) <= cap
        assert {i: sum(t for _, _, t in v) for i, v in got.items()} == {i: n for i, n in sizes.items() if n}
        for i, v in got.items():
            v.sort()
            assert len(v) == -(-sizes[i] // cap) and [s for _, s, _ in v] == [k * cap for k in range(len(v))]
        rest = sorted((n % cap or cap for n in sizes.values() if n), reverse=True)
        bins: list[int] = []
        for n in rest:  # best fit decreasing, which sees all items at once
            fits = [i for i, free in enumerate(bins) if free >= n]
            if fits:
                bins[min(fits, key=bins.__getitem__)] -= n
            else:
                bins.append(cap - n)
        whole = sum((n - 1) // cap for n in sizes.values() if n)
        assert len(room) <= 1.06 * (len(bins) + whole) + 1
    assert all(0.8 < r["filled"] <= 1 for r in packing.fill(out).collect())
    assert packing.pack(df.limit(0), win).count() == 0
    twice = packing.pack(spark.createDataFrame([(1, 250), (1, 250)], "doc_id long, tokens long"), win.where("window_id = 'w'"))
    assert twice.groupBy("container").sum("tokens").where("`sum(tokens)` > 100").count() == 0 and twice.agg({"tokens": "sum"}).first()[0] == 500


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "a b c", "s"), (2, None, None), (3, "", "s"), (4, "ب" * 20000, "s")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["tokens"] for r in tokens.with_token_counts(df, "doc_id", "text", "source").collect()}
    assert got[1] == tokens.count("a b c") == 3 and got[2] == got[3] == 0 and got[4] > 1000


# --- mixing --------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=12), st.integers(1, 400))
def test_pfair_never_departs_by_a_block(weights, slots):
    total = sum(weights)
    shares = {f"s{i}": w / total for i, w in enumerate(weights)}
    order = mixing.pfair(shares, slots)
    assert len(order) == slots
    seen = Counter()
    for t, s in enumerate(order, 1):
        seen[s] += 1
        for k, w in shares.items():
            assert abs(seen[k] - w * t) < 1 + 1e-6


def test_mix(spark):
    rng = random.Random(3)
    rec = [(i, "big", rng.randint(1, 400)) for i in range(4000)] + [(10_000 + i, "small", rng.randint(1, 60)) for i in range(300)] + [(20_000 + i, "mid", 50) for i in range(900)]
    rec += [(1, None, 50), (2, "untargeted", 50), (3, "big", 0), (4, "big", None)]
    df = spark.createDataFrame(rec, "doc_id long, source string, tokens long").withColumnRenamed("tokens", "t").selectExpr("*", "t as tokens", "1 as uses", "2 as slot")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 3), ("mid", 0.2, 2), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix = mixing.Mix(df, targets)
    shares = {r["source"]: r for r in mix.shares().collect()}
    assert shares["absent"]["tokens"] == 0
    for s, w in (("big", 5 / 9), ("small", 2 / 9), ("mid", 2 / 9)):
        assert abs(shares[s]["reached_share"] - w) < 0.01
    rows = mix.records().collect()
    cap = {"big": 1, "small": 3, "mid": 2}
    assert all(1 <= r["uses"] <= cap[r["source"]] for r in rows) and shares["small"]["most_uses"] == 3
    assert all(len(r["slots"]) == r["uses"] and None not in r["slots"] and list(r["slots"]) == sorted(r["slots"]) for r in rows)
    # Repeats included, no source departs from its share by a block (and the record that ends it) at any time.
    placed = defaultdict(Counter)
    for r in rows:
        for at in r["slots"]:
            placed[r["source"]][at] += r["tokens"]
    for s, w in (("big", 5 / 9), ("small", 2 / 9), ("mid", 2 / 9)):
        have, most = 0, 0.0
        for t in range(len(mix.schedule)):
            have += placed[s][t]
            most = max(most, abs(have - w * (t + 1) * mix.block) if t + 1 < len(mix.schedule) else 0)
        assert most < mix.block + 400, (s, most, mix.block)
    # Nothing that is left would fit: a record unused to its cap is larger than its source's room.
    left = {s: mix.quota.where(f"source = '{s}'").first()["quota"] - sum(r["tokens"] * r["uses"] for r in rows if r["source"] == s) for s in cap}
    used = {(r["doc_id"], r["source"]): r["uses"] for r in rows}
    for i, s, n in rec:
        if s in cap and n and used.get((i, s), 0) == 0:
            assert n > left[s]
    whole = mixing.Mix(df, targets, total=50_000, block=700)
    assert len(whole.schedule) == 72 and sum(r["quota"] for r in whole.quota.collect()) == 50_000
    none = mixing.Mix(df.limit(0), targets)
    assert none.records().count() == 0 and none.shares().count() == 4


# --- toxic passages --------------------------------------------------------------------


@pytest.fixture(scope="module")
def tagger():
    return toxicity.train(toxic_seed.sentences())


def worst(tagger, text):
    return max(toxicity.passage_score(m)[0] for m in tagger.marginals([tagger.ids(tagger.vocabulary.tokens(s)) or [2] for s in toxicity._SPLIT.split(text)]))


def test_held_out_patterns():
    """Whole patterns, with all their fillings, are kept from the training: everyday language carries over to half of them."""
    rng = random.Random(4)
    patterns = toxic_seed.patterns()
    rng.shuffle(patterns)
    test = patterns[: len(patterns) // 3]
    t = toxicity.train(toxic_seed.sentences([p for p in patterns if p not in test]))
    known = {x: y for s in toxic_seed.sentences(test, per_pattern=4, seed=99) for x, y in s}
    hit = [(y, worst(t, x) >= toxicity.THRESHOLD) for x, y in sorted(known.items())]
    found = sum(p for y, p in hit if y)
    assert found > 0.45 * sum(y for y, _ in hit) and found > 0.7 * sum(p for _, p in hit)


def test_learns_from_reviews(spark):
    """Passages of patterns that no labelled sentence holds are learned from reviewed documents, and so are harmless look-alikes."""
    rng = random.Random(6)
    boiler = ["the ferry leaves at noon", "the sails were mended again", "we counted the barrels twice", "rain fell all week on the quay", "the pilot drew a new chart", "two ropes are missing from the store"]
    curse = ["may wasps nest in your boots, {x}", "{x} ought to be fed to the crabs", "may the anchor drag {x} down"]
    report = ["the mate noted that wasps nest in the boots of the watch", "the crabs ought to be fed at dusk"]
    names = ["Orlin", "Tamsa", "Berkut", "Jorvik", "Sedna"]
    docs, reviews, toxic = [], [], set()
    for i in range(900):
        s = rng.sample(boiler, 3)
        if i % 6 == 0:
            s.insert(rng.randint(0, 3), rng.choice(curse).format(x=rng.choice(names)))
            toxic.add(i)
        elif i % 6 == 1:
            s.insert(rng.randint(0, 3), rng.choice(report))
        docs.append((i, ". ".join(s).capitalize() + "."))
        if i < 500:
            for r in range(3):
                wrong = rng.random() < 0.05
                reviews.append((i, f"r{r}", "abusive" if (i in toxic) != wrong else "ok"))
    docs += [(1000, None), (1001, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    r = spark.createDataFrame([*reviews, (None, "r1", "ok"), (3, None, None), (4, "r1", "???"), *reviews[:5]], "doc_id long, reviewer string, verdict string")
    got = {x["doc_id"] for x in toxicity.score(d, toxicity.fit(d, r)).where(f"score >= {toxicity.THRESHOLD}").collect()}
    unseen = {i for i in toxic if i >= 500}
    assert len(got & unseen) >= 0.9 * len(unseen) and len(got - toxic) <= 0.1 * len(toxic)
    assert isinstance(toxicity.fit(d.limit(0), r.limit(0)), toxicity.Tagger)


@pytest.mark.parametrize("spelling", ["idiot", "IDIOT", "1d10t", "i d i o t", "i.d.i.o.t", "idiiiiot", "id​iot", "i***t", "ｉdiot"])
def test_disguises(tagger, spelling):
    assert worst(tagger, f"Go to hell with your corrections, {spelling}!") >= toxicity.THRESHOLD
    assert "idiot" in tagger.vocabulary.tokens(f"you {spelling} there")


def test_reports_are_no_cases(tagger):
    for t in ("Users who write moron to others will be banned.", "The vet treated the dog, the pig and the cow.", "This software is awful and crashes all day.", "كلمة حمار إهانة لا نقبلها", "", "12 34", "???"):
        assert worst(tagger, t) < toxicity.THRESHOLD, t


def test_marginals_against_enumeration(tagger):
    import itertools

    import numpy as np

    ids = tagger.ids(tagger.vocabulary.tokens("you are a pig my dear friend"))
    starts = np.zeros(len(ids), bool)
    starts[0] = True
    e = tagger.weights[toxicity.features(np.array(ids), starts)].sum(axis=1)
    total, marg = 0.0, np.zeros(len(ids))
    for y in itertools.product((0, 1), repeat=len(ids)):
        s = np.exp(sum(e[i] for i in range(len(ids)) if y[i]) + sum(tagger.trans[a, b] for a, b in zip(y, y[1:])))
        total += s
        marg += s * np.array(y)
    assert np.allclose(tagger.marginals([ids])[0], marg / total, atol=1e-6)


def test_score(spark, tagger):
    rows = [(1, "Fine page. You are a pathetic moron. Thanks."), (2, "Thanks, that reading convinces me."), (3, None), (4, ""), (5, "The codex carries a gloss. " * 5000), (6, "y" * 50_000), (1, "Thanks.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as _key")
    got = toxicity.score(df, tagger, spans=True).collect()
    assert len(got) == 7
    hit = [r for r in got if r["score"] >= toxicity.THRESHOLD]
    assert [r["doc_id"] for r in hit] == [1] and rows[0][1][hit[0]["start"] : hit[0]["end"]] == hit[0]["passage"] and "moron" in hit[0]["passage"]
    assert {r["score"] for r in got if r["doc_id"] in (3, 4)} == {0.0}
    assert toxicity.score(df.limit(0), tagger).count() == 0


def test_reviewed(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    votes = [(i, r, "ok") for i in range(50) for r in "abc"] + [(i, r, "hateful") for i in range(50, 58) for r in "abc"] + [(58, "a", "ok"), (58, "b", "abusive")]
    rev = spark.createDataFrame([*votes, (0, "a", "ok"), (0, None, "unsure"), (59, "a", None)], "doc_id long, reviewer string, verdict string")
    clean, toxic = toxicity.reviewed(docs, rev)
    assert sorted(clean) == sorted(f"text {i}" for i in range(50)) and sorted(toxic) == [f"text {i}" for i in range(50, 58)]
    assert [len(x) for x in toxicity.reviewed(docs, rev, most=1)] == [1, 1]


def test_careless_reviewers_count_less(spark):
    """Where two differ, the one who mostly agrees with the others is believed."""
    rng = random.Random(1)
    votes = []
    for i in range(300):
        bad = i % 5 == 0
        votes += [(i, "careful", "abusive" if bad else "ok"), (i, "second", "abusive" if bad else "ok"), (i, "careless", rng.choice(["abusive", "ok"]))]
    votes += [(1000, "careful", "ok"), (1000, "careless", "abusive"), (1001, "careful", "abusive"), (1001, "careless", "ok")]
    p = {r["doc_id"]: r["p"] for r in toxicity.judged(spark.createDataFrame(votes, "doc_id long, reviewer string, verdict string")).collect()}
    assert p[1000] < 0.05 and p[1001] > 0.8
