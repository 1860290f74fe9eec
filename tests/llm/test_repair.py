"""Wrong decoding, look-alikes, cut texts, scan noise: held-out cases made here, and edge cases."""

import random

import pytest

from warraq.llm import homoglyph, mojibake, scannoise, truncation, wording
from warraq.llm.queries import queries

WORDS = "قال كتاب هذا ذلك إلى على كان لم قبل بعد عند تحت فوق الكاتب الناظر وفرس السهم القوس رجل باب علم نار ماء حجر شجر طير خيل سيف رمح قلم حبر ورق درس".split()


def text(rng, words=40, line=8):
    w = [rng.choice(WORDS) for _ in range(words)]
    return "\n".join(" ".join(w[i : i + line]) for i in range(0, words, line)) + "."


def frame(spark, rows, extra=False):
    """rows of (row_id, page_id, system, text); with columns that clash with internal names on demand."""
    df = spark.createDataFrame(rows, "row_id long, page_id string, system string, text string")
    if extra:
        for c in ("_key", "_text", "_page", "value", "tokens", "pivot", "n", "edits"):
            df = df.selectExpr("*", f"'x' as `{c}`")
    return df


CHAINS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1256"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1256", "latin-1"), ("iso8859_6", "latin-1")]


def test_chain_round_trips():
    rng = random.Random(1)
    clean = [text(rng) for _ in range(300)]
    model = mojibake.CharModel(_grams(clean))
    for written, read in CHAINS:
        for words in (3, 40):
            t = text(rng, words)
            broken = t.encode(written).decode(read, "replace" if read == "cp1252" else "strict")
            spans = mojibake.garbled(broken, model)
            assert spans, (written, read)
            if "�" not in broken:
                assert mojibake.repaired(broken, spans) == t, (written, read)
    twice = clean[0].encode().decode("latin-1").encode().decode("latin-1")
    assert mojibake.repaired(twice, mojibake.garbled(twice, model)) == clean[0]
    assert not any(mojibake.garbled(t, model) for t in clean)


def _grams(texts):
    import numpy as np
    import pandas as pd

    rows = pd.concat(list(mojibake._count_grams(iter([pd.DataFrame({"value": texts})]))))
    table = np.zeros(mojibake._PLACES, np.float32)
    table[rows["place"].to_numpy()] = rows["n"].to_numpy()
    return table


FOREIGN = ["Üçüncü_grup", "Qualität", "relecture_achevée", "İncelenmiş", "Sayfalar_değişti", "Ḥāshiyat al-ṭālib", "Ærøskøbing", "Žižek_část", "Größenänderung", "hétvégéjé"]


def test_clean_foreign_names_stay(spark):
    """Accented names in composed and decomposed form are no cases; their garbled forms are, and come back without control characters."""
    import unicodedata

    rows = [(i, f"arch/{FOREIGN[i % len(FOREIGN)]}/page_{i:03d}.txt") for i in range(1000)]
    rows += [(1000 + i, unicodedata.normalize("NFD", f"arch/{FOREIGN[i % len(FOREIGN)]}/page_{i:03d}.txt")) for i in range(200)]
    bad = {}
    for i, f in enumerate(FOREIGN):
        for j, read in enumerate(("latin-1", "mac_roman", "cp1256")):
            path = f"arch/{f}/page_{i:03d}.txt"
            raw = path.encode()
            try:
                bad[2000 + 10 * i + j] = (raw.decode(read), path)
            except UnicodeDecodeError:
                continue
    rows += [(k, b) for k, (b, _) in bad.items()]
    got = {r["row_id"]: r for r in mojibake.garbled_values(spark.createDataFrame(rows, "row_id long, source_path string"), "row_id", ("source_path",)).collect()}
    assert set(got) == set(bad)
    for k, r in got.items():
        assert r["repaired"] == bad[k][1] and not any(unicodedata.category(c) == "Cc" for c in r["repaired"])


def test_is_clean():
    for t in (*FOREIGN, "Üç", "Ödön öö?", "٤٥ كتاب"):
        assert mojibake.is_clean(t), t
    for t in ("QualitÃ¤t", "deÄŸiÅŸti", "ãÑÇÌÚÉ", "deðiþti", "قال ?? كتاب"):
        assert not mojibake.is_clean(t), t


def test_margin_holds_on_clean_text():
    """No chain gains on held-out clean text, not even near the margin."""
    rng = random.Random(2)
    model = mojibake.CharModel(_grams([text(rng) for _ in range(200)]))
    for _ in range(100):
        for token in text(rng).split():
            assert mojibake._best(token, model)[0] < mojibake.MARGIN / 2


def test_garbled_values(spark):
    rng = random.Random(3)
    rows = [(i, "p", "s", text(rng)) for i in range(80)]
    rows += [(i, "p", "s", "Ḥāshiyat al-ṭālib fī wazn al-nuqūd\n" + text(rng)) for i in range(80, 95)]
    bad = rows[0][3].encode().decode("cp1256")
    rows += [(100, "p", "s", bad), (101, "p", "s", bad), (102, "p", "s", None), (103, "p", "s", ""), (104, "p", "s", rows[1][3] + " ???? ??? ??"), (105, "p", "s", rows[2][3] + "�"), (106, "p", "s", "Ḥāshiyat al-ṭālib é"), (107, "p", "s", text(rng, 60_000)), (108, "p", "s", "لم قبل¬\nه\xadذا")]
    got = {r["row_id"]: r for r in mojibake.garbled_values(frame(spark, rows, extra=True), "row_id", ("text",)).collect()}
    assert set(got) == {100, 101, 104}
    assert got[100]["repaired"] == rows[0][3] and got[101]["repaired"] == rows[0][3] and got[104]["repaired"] is None
    assert mojibake.garbled_values(frame(spark, []), "row_id", ("text",)).count() == 0


@pytest.mark.parametrize(
    ("odd", "plain"),
    [("ﻛﺘﺎﺏ", "كتاب"), ("هـ​ذا", "هـذا"), ("کتاب", "كتاب"), ("علی", "على"), ("فی ذلك", "فى ذلك"), ("ہذا", "هذا"), ("أ", "أ"), ("a\xa0b", "a b"), ("МЅ Сod", "MS Cod"), ("ｆ（１）", "f(1)"), ("۱۲", "١٢"), ("a\r\nb", "a\nb"), ("بَّ", "بَّ")],
)
def test_forms(odd, plain):
    form = homoglyph.Form()
    assert form.apply(odd) == plain and form.apply(plain) == plain


def test_forms_leave_visible_differences():
    form = homoglyph.Form()
    for t in ("", "ﷺ", "٤٥", "45", "پاچ", "النجWاء", "— - –", "ى ي", "كـب", "Москва"):
        assert form.apply(t) == t
    assert homoglyph.Form({"ک": 9, "ك": 1}).apply("كک") == "کک"  # the corpus decides


def test_consistent_form(spark):
    rows = [(1, "p", "s", "كتاب"), (2, "p", "s", "کتاب"), (3, "p", "s", None), (4, "p", "s", ""), (5, "p", "s", "x" * 200_000), (6, "p", "s", "كتاب".encode().decode("cp1252", "replace") + " ہذا"), (2, "p", "s", "کتاب")]
    rows += [(10 + i, "p", "s", "كتاب هذا") for i in range(5)]
    got = homoglyph.consistent_form(frame(spark, rows, extra=True), "row_id", "text").collect()
    by = {}
    for r in got:
        by.setdefault(r["row_id"], []).append((r["consistent"], r["changed"]))
    assert by[1] == [("كتاب", False)] and by[2] == [("كتاب", True)] * 2 and by[3] == [(None, False)] and by[4] == [("", False)]
    assert by[5][0][1] is False and by[6][0][1] is True
    assert homoglyph.consistent_form(frame(spark, []), "row_id", "text", only_changed=True).count() == 0


# --- cut texts -----------------------------------------------------------------


def test_missing_end():
    page = "a1 b2 c3 d4 e5 f6 g7 h8".split()
    assert truncation.verdict(" ".join(page), " ".join(page)) == 0
    assert truncation.verdict("z0 a1 b2 c3 d4 e5 f6", " ".join(page)) > 0
    assert truncation.verdict("b2 c3 d4 e5 f6 g7 h", " ".join(page)) > 0  # cut inside the last word
    assert truncation.verdict("a1 b2 c3 d4 e5 f6 g7 x8", " ".join(page)) == 0  # misread
    assert truncation.verdict("a1 b2 c3 e5 f6 g7 h8", " ".join(page)) == 0  # overlooked inside
    assert truncation.verdict("", " ".join(page)) == 0 and truncation.verdict("a1", "") == 0


def test_truncated_pages(spark):
    rng = random.Random(4)
    rows, cut, k = [], set(), 0
    for p in range(60):
        t = text(rng, 60)
        for s in ("gt_a", "gt_b", "kraken", "vision"):
            x = t
            if s == "kraken" and p % 3 == 0:
                x = t[:120]  # a field limit
                cut.add(k)
            if s == "vision" and p % 10 == 1:
                x = t[: rng.randint(40, len(t) - 30)].rstrip() + "…"
                cut.add(k)
            if s == "vision" and p % 10 == 2:
                lines = t.split("\n")
                x = "\n".join(lines[:2] + lines[3:])  # a line overlooked
            rows.append((k, f"page_{p:02d}", s, x + ("\n[٤٣]" if s == "kraken" and k not in cut else "")))
            k += 1
    rows += [(k, "page_00", "kraken", None), (k + 1, "page_00", "kraken", ""), (k + 2, None, "vision", "x"), (k + 3, "page_77", "vision", "لا شيء غيره...")]
    df = frame(spark, rows, extra=True)
    got = {r["row_id"]: r["reason"] for r in truncation.truncated(df).collect()}
    assert set(got) == cut | {k + 3}
    assert {got[i] for i in cut if rows[i][2] == "kraken"} == {"field limit"}
    peaks = {(r["source"], r["measure"], r["length"]) for r in truncation.limits(truncation.endings(df)).collect()}
    assert ("kraken", "chars", 120) in peaks
    rate = {r["system"]: (r["rows"], r["cut"]) for r in truncation.rates(df).collect()}
    assert rate["kraken"] == (62, 20) and rate["gt_a"] == (60, 0)
    assert truncation.truncated(frame(spark, [])).count() == 0


# --- scan noise -----------------------------------------------------------------


@pytest.mark.parametrize("line", ["٢٧/ب", "— 60 —", "ق ٤٥ ظ", "Page 3", "f. 12v", "[٤٣]", "صفحة ٤", "٢٨أ", "12 .", "* ٥ *", "ورقة ٩"])
def test_folios(line):
    assert wording.is_folio(line)


@pytest.mark.parametrize("line", ["", "12) و؟", "كتاب 3", "قال", "--", "x" * 500 + "1"])
def test_no_folios(line):
    assert not wording.is_folio(line)


def noisy(rng, t, kinds):
    lines = t.split("\n")
    if "hyphen" in kinds:
        a = lines[1].split()
        w = max(a, key=len)
        i = a.index(w)
        lines[1:2] = [" ".join(a[:i] + [w[:2] + "-"]), " ".join([w[2:]] + a[i + 1 :])]
    if "char" in kinds:
        a = lines[-2].split()
        i = max(range(len(a)), key=lambda k: len(a[k]))
        a[i] = a[i][0] + "%" + a[i][2:]
        lines[-2] = " ".join(a)
    if "header" in kinds:
        lines.insert(0, rng.choice(["كتاب المعيار في ضبط الموازين", "[ الباب الثالث ]"]))
    if "pageno" in kinds:
        lines.append(f"— {rng.randint(1, 99)} —")
    return "\n".join(lines)


def test_scan_noise(spark):
    rng = random.Random(5)
    rows, want, k = [], set(), 0
    for p in range(150):
        t = text(rng, 48)
        for s in ("gt_a", "gt_b", "kraken", "vision"):
            kinds = {x for x in scannoise.KINDS if rng.random() < 0.12} if s in ("kraken", "vision") else set()
            rows.append((k, f"page_{p:03d}", s, noisy(rng, t, kinds)))
            want |= {(k, x) for x in kinds}
            k += 1
    rows += [(k, "page_000", "kraken", None), (k + 1, "page_000", "kraken", ""), (k + 2, None, "kraken", "قال كتاب"), (k + 3, "page_000", "vision", rows[0][3].encode().decode("cp1252", "replace"))]
    noise = scannoise.ScanNoise(frame(spark, rows, extra=True))
    got = {tuple(r) for r in noise.found().collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want), (sorted(want - got)[:5], sorted(got - want)[:5])
    text_of = {r["row_id"]: r["repaired"] for r in noise.paragraphs().collect()}
    clean = {p: x for _, p, s, x in rows if s == "gt_a"}
    exact = [i for i, p, s, _ in rows[:-4] if s == "kraken" and text_of[i].split() == clean[p].split()]
    assert len(exact) >= 0.9 * 150
    assert k not in text_of and k + 1 not in text_of and k + 3 not in text_of
    assert scannoise.ScanNoise(frame(spark, [])).found().count() == 0


def test_query_names():
    names = set(queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 8)} <= names and any(n.startswith("p6_") for n in names) and any(n.startswith("p7_") for n in names)


def test_lengths_against_python():
    """Lengths under encodings and escapings equal those of Python's own encoders."""
    import html
    import json

    texts = ["", "abc", "قال كتاب\nهذا", 'a"b\\c\td\r\x0b\x00&<>\'"', "é߀", "ā✐￿", "😀𐍈", "\U000f4240\U00020000", "x" * 5000, "\x7f\x80ϧϨ✏"]
    want = {
        "chars": len, "utf8": lambda t: len(t.encode()), "utf16": lambda t: len(t.encode("utf-16-le")) // 2, "html": lambda t: len(html.escape(t)),
        "entities": lambda t: len(t.encode("ascii", "xmlcharrefreplace")), "json": lambda t: len(json.dumps(t)) - 2, "json_utf8": lambda t: len(json.dumps(t, ensure_ascii=False).encode()) - 2,
        "crlf": lambda t: len(t.replace("\n", "\r\n")), "utf8_crlf": lambda t: len(t.replace("\n", "\r\n").encode()),
    }
    assert tuple(want) == truncation.LENGTHS
    for t in texts:
        assert dict(zip(want, truncation.lengths(t))) == {k: f(t) for k, f in want.items()}, repr(t)


def test_limits_need_significance_and_decide(spark):
    """A pile-up of pages at one length is a limit, one page delivered often is none; at a limit a misread last word is enough."""
    rng = random.Random(12)
    rows, k = [], 0
    for p in range(400):
        t = text(rng, rng.randint(30, 80))
        for s in ("gt_a", "gt_b"):
            rows.append((k, f"page_{p}", s, t))
            k += 1
        x = t[:150].rstrip() if p % 8 == 0 else t
        rows.append((k, f"page_{p}", "kraken", x))
        k += 1
    hot = text(rng, 50)
    rows += [(k + i, "page_hot", "kraken", hot) for i in range(60)]
    k += 60
    misread = rows[8 * 3][3][:145]
    misread = misread[: misread.rindex(" ") + 1]
    misread += "ظ" * (150 - len(misread))
    rows.append((k, "page_8", "kraken", misread))
    df = frame(spark, rows)
    peaks = {(r["source"], r["measure"], r["length"]) for r in truncation.limits(truncation.endings(df)).collect()}
    assert ("kraken", "chars", 150) in peaks and ("kraken", "chars", len(hot)) not in peaks
    got = {r["row_id"]: r["reason"] for r in truncation.truncated(df).collect()}
    assert got[k] == "field limit" and not any(i in got for i in range(1200, 1260))


# --- look-alike scripts ----------------------------------------------------------


def test_scripts(spark):
    """Mixed and whole-script look-alikes are spelled in the script that fits; genuine words of any script stay."""
    looks = homoglyph.skeletons(spark)
    assert looks and looks["о"] == looks["o"] == looks["ο"] == looks["օ"]
    corpus = "the codex Cod. MS quick brown fox jumps over lazy dogs Москва Россия сообщение было утром жизнь щука ελληνικά γλώσσα Հայերեն լեզու قال كتاب "
    letters = {c: 10 * corpus.count(c) for c in corpus if c.isalnum()} | {c: 200 for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    letters |= {c: 1 for c in "МЅСосаеρхօսՏοΑАЕ"}
    form = homoglyph.Form(letters, looks)
    cases = {
        "قال МЅ كتاب": "قال MS كتاب",  # whole-script, Latin unmistakable in the corpus
        "the Сodex": "the Codex",  # one Cyrillic letter in a Latin word
        "Мoсква": "Москва",  # one Latin letter in a Cyrillic word
        "Россия и сосо": "Россия и сосо",  # a genuine Russian line keeps its words
        "the сосо": "the coco",
        "ελληνικά γλώσσa": "ελληνικά γλώσσα",
        "Հայերեն օս": "Հայերեն օս",
        "النجWاء": "النجWاء",
        "Москва": "Москва", "ελληνικά": "ελληνικά", "Հայերեն": "Հայերեն",
    }
    for odd, plain in cases.items():
        assert form.apply(odd) == plain and form.apply(plain) == plain, odd
