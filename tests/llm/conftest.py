"""Small document tables."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_tokens long, id string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from texts or (id, text), with columns that clash with the operators' own."""

    def make(texts):
        rows = [(x if isinstance(x, tuple) else (i, x)) for i, x in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "src0", 7, "x") for i, t in rows], DOCS)

    return make
