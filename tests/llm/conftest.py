import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string, n long, word string, score double, host string, digest string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls everywhere, empty and very long texts, repeated rows, ties, and columns whose names the operators use too."""
    def row(doc_id, text, lang="en", source="a"):
        return (doc_id, text, lang, source, None if text is None else len(text), "x", 1, "w", 0.5, "h", "d")
    words = " ".join(f"word{i % 977}x{i % 31}" for i in range(40_000))
    rows = [row(1, "Plain words make a plain text, and it is long enough to keep."), row(2, None), row(3, ""), row(4, " \n\t "), row(5, words),
            row(6, "Plain words make a plain text, and it is long enough to keep."), row(1, "Plain words make a plain text, and it is long enough to keep."),
            row(None, "A row without an id still has a text."), row(7, "été à la plage — 日本語 \U0001f600 ß"), row(8, "12345 67890 !!!", None, None),
            row(9, "one"), row(10, "token = abcdefghijklmnop", "fr", None), row(11, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
