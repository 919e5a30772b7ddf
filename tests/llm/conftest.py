from __future__ import annotations

import pytest

LONG = "word " * 30_000 + "end"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null, empty, blank, repeated and very long texts, null and repeated ids, columns with clashing names."""
    texts = [
        (1, None),
        (2, ""),
        (3, " \n\t"),
        (4, "one two three four five six seven"),
        (5, "one two three four five six seven"),
        (6, "ONE two three four five six seven"),
        (7, "one two"),
        (8, "one two"),
        (9, LONG),
        (9, LONG),
        (10, "12 + 34 !"),
        (None, "one two three four five six seven"),
        (None, None),
    ]
    rows = [(i, t, 7, 8, True, 1, 2, 0.5, "b", 3, "x") for i, t in texts]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, id long, n long, kept boolean, label int, task int, score double, body string, "
        "shard int, sha string",
    )


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def edge_texts(edge_docs):
    return [(r.doc_id, r.text or "") for r in edge_docs.collect()]
