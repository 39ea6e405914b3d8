"""Small document tables with the awkward cases that every operator must take."""

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, host string, copies int, words string"


def awkward(spark, rows=()):
    """Documents with nulls, empty and long texts, repeats, and extra columns with clashing names."""
    base = [
        (1, "Plain words in a short text.", "en", "a"),
        (2, None, "en", "a"),
        (3, "", "fr", None),
        (4, "same text here\nsame text here\n", None, "b"),
        (5, "same text here\nsame text here\n", None, "b"),
        (5, "same text here\nsame text here\n", None, "b"),
        (None, "a row without an id but with words", "en", "c"),
        (7, "long " * 30000, "en", "a"),
        (8, " \t\n ", "de", "c"),
        (9, "ünïcödé ☃ 𝄞 " * 5, "de", "c"),
        *rows,
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "h", 2, "w") for r in base], DOC)


@pytest.fixture(scope="session")
def odd_docs(spark):
    return awkward(spark).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
