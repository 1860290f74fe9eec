"""Scan noise judged against everything the page's annotators wrote."""

import random

from test_repair import WORDS, frame, noisy, text

from warraq.llm import scannoise
from warraq.llm.homoglyph import Form

TITLES = ["كتاب المعيار في ضبط الموازين", "الباب الثالث", "فصل في السهام", "مقالة السالك", "ذكر الأقواس", "شرح المنازل"]


def test_every_annotator_is_read(spark):
    """A title that a single annotator of the page wrote too is text, however many there are and whatever page."""
    rng = random.Random(6)
    rows, k = [], 0
    for p in range(60):
        t = text(rng, 48)
        for s in ("gt_a", "gt_b", "kraken", "vision"):
            rows.append((k, f"page_{p:03d}", s, noisy(rng, t, {"header"} if s == "kraken" and p % 3 == 0 else set())))
            k += 1
    first = k
    for page, copies in (("few", 1), ("crowded", 15)):
        t = text(rng, 48)
        for i, title in enumerate(TITLES):
            for c in range(copies):
                rows.append((k, page, f"gt_{i}", title + "\n" + t.replace(" ", "  " if c % 2 else " ", c)))
                k += 1
            rows.append((k, page, "kraken", title + "\n" + t))
            k += 1
        rows.append((k, page, "vision", "تنبيه الغافلين\n" + t))
        k += 1
    got = {tuple(r) for r in scannoise.ScanNoise(frame(spark, rows)).found().collect()}
    late = {(i, x) for i, x in got if i >= first}
    assert late == {(r[0], "header") for r in rows[first:] if r[2] == "vision"}


def test_merged_parts_know_the_same():
    rng = random.Random(7)
    texts = [text(rng, 30) + f"\n— {i} —" for i in range(9)]
    form, whole, parts = Form(), scannoise.Known(), scannoise.Known()
    whole.add(texts, form)
    for i in range(0, 9, 2):
        part = scannoise.Known()
        part.add(texts[i : i + 2], form)
        parts.merge(scannoise.Known.loads(part.dumps()))
    assert whole.dumps() == parts.dumps() or all(getattr(whole, x) == getattr(parts, x) for x in (*whole.SETS, "tails"))
    assert whole.folios == {str(i) for i in range(9)}


def test_endings_and_comments_of_annotators():
    t = "قال كتاب هذا ذلك إلى على كان لم قبل بعد عند تحت فوق السهم القوس رجل باب علم"
    page = scannoise.Page((t, "# Page 7, one line per line.\n" + t, " ".join(t.split()[:12])), Form())
    assert len(page.tails) == 1  # a cut annotator's ending is not the page's
    assert "7" not in page.numbers  # a comment is no transcription


def test_garbled_and_cut_texts_keep_their_paragraphs(spark):
    rng = random.Random(8)
    rows, texts = [], []
    for p in range(40):
        texts.append(text(rng, 48))
        rows += [(4 * p + i, f"page_{p:02d}", s, texts[p]) for i, s in enumerate(("gt_a", "gt_b", "kraken", "vision"))]
    lines = texts[0].split("\n")
    broken = lines[2].encode().decode("cp1252", "replace")
    rows += [(900, "page_00", "kraken", "\n".join(["تنبيه الغافلين", *lines[:2], broken, *lines[3:]])), (901, "page_01", "kraken", texts[1][:100]), (902, "page_02", "kraken", texts[2].encode().decode("cp1252", "replace"))]
    noise = scannoise.ScanNoise(frame(spark, rows))
    got = {r["row_id"]: (r["repaired"], r["state"]) for r in noise.paragraphs(unread=True).collect()}
    assert set(got) == {r[0] for r in rows if not r[2].startswith("gt_")}
    assert got[900][1] == "garbled" and " ".join(broken.split()) in got[900][0] and " ".join(lines[4].split()) in got[900][0]
    assert got[901] == (" ".join(texts[1][:100].split()), "cut") and got[902] == (rows[-1][3], "unread")
    assert got[2] == (" ".join(texts[0].split()), None)
    assert not {r["row_id"] for r in noise.found().collect()} & {900, 901, 902}


def test_breaks_for_one_text_are_those_of_a_batch():
    rng = random.Random(9)
    model = scannoise.BreakModel()
    ends = ["".join(rng.choice("01234567") for _ in range(rng.randint(1, 30))) for _ in range(50)]
    marg = model.marginals(ends)[0]
    for x, m in zip(ends, marg):
        assert model.breaks(x) == (m[: len(x)] > 0.5).tolist()
    assert model.breaks("") == []


def test_line_ends():
    full = "قال كتاب هذا ذلك إلى على كان لم قبل بعد"
    assert scannoise.line_ends(f"# note\n{full}\nقبل بعد.\n\n{full}.\n  {full}\nقال\n") == "07502"
    assert scannoise.line_ends("") == ""


def test_paragraphs_end_at_labelled_breaks(spark):
    """A stop at the end of a full line inside a paragraph breaks nothing; a short last line and a gap do, with a stop or without."""
    rng = random.Random(10)
    rows, want = [], {}
    for p in range(200):
        paragraphs, lines = [], []
        for _ in range(3):
            body = [" ".join(rng.choices(WORDS, k=9)) for _ in range(3)] + [" ".join(rng.choices(WORDS, k=3))]
            if rng.random() < 0.3:
                body[1] += "."  # a sentence that ends at a line's end
            body[-1] += "." if rng.random() < 0.8 else ""
            paragraphs.append(" ".join(body))
            lines += body + ([""] if p % 2 else [])
        rows += [(2 * p, f"page_{p}", "gt_a", "\n".join(lines)), (2 * p + 1, f"page_{p}", "kraken", "\n".join(lines))]
        want[2 * p + 1] = paragraphs
    got = {r["row_id"]: r["repaired"].split("\n\n") for r in scannoise.ScanNoise(frame(spark, rows)).paragraphs().collect()}
    right = sum(got[k] == v for k, v in want.items())
    assert right >= 0.9 * len(want), right
