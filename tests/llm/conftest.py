import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, toxic_spans string, kept boolean"


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts, blanks, ties, a repeated row, a row without identifier, a long text, and columns whose names operators use."""
    words = " ".join(f"word{i % 977}x{i % 13}" for i in range(9000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two three"), (5, "One two three"), (6, "one two three"), (6, "one two three"), (None, "no identifier here at all"), (8, words), (9, words + " tail"), (10, "é中文😀 <|endoftext|> it's"), (11, None)]
    return spark.createDataFrame([(i, t, "en", None, None, 0.5, "x", True) for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
