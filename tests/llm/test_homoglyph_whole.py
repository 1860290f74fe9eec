"""Look-alikes come from all confusables or not at all: a failure to read them is no result."""

from types import SimpleNamespace

import pytest

from warraq.llm import homoglyph


def icu(skeleton):
    """A session whose JVM has a library that answers with ``skeleton``."""
    checker = SimpleNamespace(getSkeleton=skeleton)
    spoof = SimpleNamespace(Builder=lambda: SimpleNamespace(build=lambda: checker))
    return SimpleNamespace(_jvm=SimpleNamespace(com=SimpleNamespace(ibm=SimpleNamespace(icu=SimpleNamespace(text=SimpleNamespace(SpoofChecker=spoof))))))


def lost(text):
    raise ConnectionError("gateway lost")


@pytest.mark.parametrize("session", [SimpleNamespace(), icu(lost), icu(lambda t: t[:-2]), icu(lambda t: None)], ids=["no JVM", "lost", "short", "null"])
def test_failure_is_an_error(session):
    with pytest.raises(RuntimeError):
        homoglyph.skeletons(session)


class Without:
    """The session's JVM, a library's classes missing from it."""

    def __init__(self, jvm):
        self.jvm = jvm

    def __getattr__(self, name):
        return self.jvm.no.such.library if name == "com" else getattr(self.jvm, name)


def test_missing_library_gives_no_rows(spark, monkeypatch):
    """Armenian and Coptic look-alikes are none of the built-in ones: without the library their rows would be left out."""
    texts = ["the quick brown fox jumps over the lazy dog"] * 20 + ["the cօdex", "the ⲥodex", "the сodex"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    got = {r["row_id"]: r["consistent"] for r in homoglyph.consistent_form(df, "row_id", "text", only_changed=True).collect()}
    assert got == dict.fromkeys((20, 21, 22), "the codex")
    with monkeypatch.context() as m:
        m.setattr(spark, "_jvm", Without(spark._jvm))
        with pytest.raises(RuntimeError, match="ICU"):
            homoglyph.consistent_form(df, "row_id", "text", only_changed=True)
