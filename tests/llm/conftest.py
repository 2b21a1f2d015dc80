import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def make(rows):
        full = [(*r, None, None)[:4] + (None if r[1] is None else len(r[1]), 1, 2, 3) for r in rows]
        kinds = "doc_id long, text string, lang string, source string, n_chars long, key long, token int, label int"
        return spark.createDataFrame(full, kinds)

    return make
