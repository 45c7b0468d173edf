"""Documents for tests."""

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n int, root string"


@pytest.fixture
def make_docs(spark):
    """Documents from texts (ids from 0) or (id, text) pairs, with columns whose names clash."""

    def make(*rows):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame(
            [(i, t, None, "s", None if t is None else len(t), 0.5, 7, "x") for i, t in pairs], DOCS
        )

    return make
