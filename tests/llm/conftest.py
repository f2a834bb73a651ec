import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside; they are to be left alone.
CLASH = "score double, key long, rep long, component string, bucket int, sequence_id string, salt string, a string, b string, spans string, _gone string, x string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and extra columns."""
    text = "The quick brown fox jumps over the lazy dog and then it runs away from the farm at night."
    rows = [
        (1, text, "en", "s"), (2, text, None, None), (2, text, None, None), (3, None, "en", "s"), (4, "", "en", "s"), (5, " \n\t ", "en", "s"),
        (None, text, "en", "s"), (None, None, None, None), (6, "word " * 30_000, "en", "s"), (7, "é€😀 \x00 ÀB", "fr", "s"), (8, "one", "en", "s"), (9, text.upper(), "en", "s"), (9, "another text under the same id", "en", "s"),
        (10, "mail me at some.one@example.org or +1 (555) 010-9999, 10.0.0.1, 4111 1111 1111 1111", "en", "s"),
    ]
    extra = (0.5, 7, 8, "c", 1, "q", "s", "a", "b", "p", "g", "x")
    return spark.createDataFrame([(i, t, l, s, len(t or ""), *extra) for i, t, l, s in rows], f"{DOCS}, {CLASH}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
