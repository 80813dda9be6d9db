import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) rows, with extra columns whose names clash with the operators' own."""

    def make(rows):
        full = [(i, t, "x", "y", 1, "z") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, node string, spans string, n_chars long, _text string").repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a very long text and characters of all kinds."""
    long = "a very long text of the same few words and one id " * 4000
    return [
        (1, None), (2, ""), (3, " \n\t "), (None, "no id here at all, my friend"), (None, None), (4, "one"), (5, "one"),
        (6, "same row of five words or more"), (6, "same row of five words or more"), (7, long), (8, "ÀÉß 中文 🙂 “quoted” é İ Σ"), (9, "x" * 3000),
    ]
