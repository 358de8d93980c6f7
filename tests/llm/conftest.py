import pytest

#: Rows that every text operator must take: nulls, empty and blank texts, repeated rows, a very long text, look-alike columns.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, score double"


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [
        (1, "The quick brown fox jumps over the lazy dog", "en", "a", 43),
        (1, "The quick brown fox jumps over the lazy dog", "en", "a", 43),
        (2, None, "en", "a", 0),
        (3, "", None, "b", 0),
        (4, " \t\n ", "fr", None, 4),
        (None, "A row without an id", "en", "b", 19),
        (5, "word " * 30_000, "en", "b", 150_000),
        (6, "12345 !!! ??? 67", "de", "c", 16),
        (7, "éèê über señor naïve Ǆ \U0001f600 \x00 x", "es", "c", 20),
    ]
    return spark.createDataFrame([(*r, "clash", 1.0) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
