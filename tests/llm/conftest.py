import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, shard int, fp long, size string, host string, _extra string"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with the names of results."""
    long_text = "lorem ipsum dolor " * 20_000
    rows = [
        (1, "the cat sat on the mat and then it slept all day", "en", "a", 40),
        (1, "the cat sat on the mat and then it slept all day", "en", "a", 40),
        (2, "THE CAT sat on the mat and then it slept all day", "en", "b", None),
        (3, "", "en", "a", 0),
        (4, None, None, None, None),
        (None, "no id at all here", "fr", None, 17),
        (5, "one", "fr", "b", 3),
        (6, " \t\n\r ", None, "c", 5),
        (7, long_text, "la", "c", len(long_text)),
        (8, "déjà vu 😀 £5 | #tag\nline two\n\nline two", "fr", "a", 30),
        (8, "same id but another text", "en", "a", 24),
    ]
    return spark.createDataFrame([(*r, 9, 8, 7, "s", "h", "x") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
