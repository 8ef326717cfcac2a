import pytest


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with those that operators make."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), 7, 8, 9) for i, t in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, part bigint, start bigint")

    return make


#: Null ids and texts, empty and blank texts, repeated rows, and one long text.
ODD = [(1, "one two three four"), (1, "one two three four"), (2, None), (None, "null id here it is"), (None, None), (3, ""), (4, " \n\t "), (5, "x " * 30000)]


@pytest.fixture
def odd():
    return list(ODD)
