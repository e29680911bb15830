import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A DataFrame of documents from texts; ids count from 0."""

    def make(*texts, lang="en"):
        return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOC)

    return make


#: nulls, empty and blank texts, very long ones, one endless word, odd characters, repeated rows
ODD = [None, "", "  \n\t ", "word", "a" * 70_000, "tail. " * 30_000, "é😀 — ß\x00\x1c x", "▁ ▁▁", "same text here", "same text here", "don't, stop... I'LL 3.14!"]


@pytest.fixture
def odd():
    return ODD
