"""Shared helpers of the operator tests."""

import pytest

CLASH = "doc_id long, text string, lang string, source string, n_chars long, h string, score double, key string, c string, rep long, extra string"


@pytest.fixture(scope="session")
def docs(spark):
    """documents with columns of clashing names."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), "h", 0.5, "k", "c", 1, "x") for i, t, s in rows]
        return spark.createDataFrame(full, CLASH)

    return make
