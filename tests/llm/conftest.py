import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, fingerprint string, size int"


def rows_of_trouble():
    """Nulls in any column, empty and blank texts, very long ones, repeated rows and clashing columns."""
    words = [f"word{i % 97}x{i % 13}" for i in range(30_000)]
    texts = [
        (1, "the quick brown fox jumps over the lazy dog " * 12, "en", "a"),
        (2, None, "en", "a"),
        (3, "", "de", None),
        (4, " \t\n\x0b\f\r ", None, "b"),
        (5, " ".join(words), "en", "b"),
        (6, "one two three", "en", ""),
        (7, "one two three", "en", "c"),
        (8, "ÀÉ ß 😀😀 end\u00a0of\u2003line\nsame\nsame\n\nlast", "fr", "c"),
        (None, "no id here at all but some words", "en", "a"),
        (None, None, None, None),
        (9, "alpha " * 4000, "en", "d"),
    ]
    rows = [(i, t, lang, s, None if t is None else len(t), "x", "y", 7) for i, t, lang, s in texts]
    return [*rows, rows[0], rows[0]]


@pytest.fixture(scope="session")
def trouble(spark):
    return spark.createDataFrame(rows_of_trouble(), DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, None), (7, 1, None), (7, 0, None)], "doc_id long, quality int, toxic int")
