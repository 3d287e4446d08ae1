from __future__ import annotations

import pytest

SF_DIR = "/root/testdata/sf0.001"
EDGES = [
    (1, None, None, "a"),
    (2, "", "en", "a"),
    (3, "  \n\t ", "en", None),
    (4, "one", "en", "a"),
    (5, "The quick brown fox jumps over the lazy dog. " * 40, "en", "a"),
    (6, "The quick brown fox jumps over the lazy dog. " * 40, "en", "a"),
    (7, "x" * 50_000, "en", "a"),
    (8, "Der schnelle braune Fuchs 12345 \U0001f600 é ▁ ▁▁", "de", "a"),
    (8, "Der schnelle braune Fuchs 12345 \U0001f600 é ▁ ▁▁", "de", "a"),
    (None, "a row without an id, long enough for five words", "en", "a"),
    (None, None, None, None),
    (9, "12345 67890 !!!", None, "a"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Awkward rows, with more columns whose names the operators use themselves."""
    rows = [(*row, i, "s", i) for i, row in enumerate(EDGES)]
    return spark.createDataFrame(
        rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, id STRING, score INT"
    )


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")
