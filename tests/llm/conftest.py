from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and repeated rows, a long text, and extra columns with names of the operators' own."""
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "  \n\t"), (None, "alpha beta gamma delta epsilon zeta"), (5, "alpha beta gamma delta epsilon zeta"), (5, "alpha beta gamma delta epsilon zeta"), (7, long), (8, "Übergröße 日本語 😀 token")]
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, word string, h1 int, length int")
