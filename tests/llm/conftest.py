"""Fixtures of small tables with awkward rows."""

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sample(spark):
    """The documents of the smallest data set."""
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, a repeated key, and columns with clashing names."""
    run = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, run + "\nline one\nline two\nline three", "en", 7, "a"),
        (2, "before " + run + " after\nline one\nline two\nline three\nend", "en", 7, "b"),
        (2, "before " + run + " after\nline one\nline two\nline three\nend", "en", 7, "b"),
        (3, None, "en", None, None),
        (4, "", None, 1, "c"),
        (5, " \n\t \n", "de", 1, "c"),
        (6, "x" * 300_000, "de", 1, "c"),
        (7, "ab " * 50_000, "de", 1, "c"),
        (8, "same key", "de", 1, "c"),
        (8, "other text with same key", "de", 1, "c"),
        (None, run, "de", 1, "c"),
        (None, None, None, None, None),
        (9, "Éİ ñ \U0001f600   zero\x00byte", "de", 1, "c"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n int, words string")


@pytest.fixture(scope="session")
def nothing(awkward):
    """The same columns without rows."""
    return awkward.limit(0)
