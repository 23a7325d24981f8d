from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns whose names clash."""
    long_text = " ".join(f"word{k % 997}" for k in range(30_000))
    rows = [
        (1, None, None, None, None, 1, 1, "x"), (2, "", "en", "s", 0, 1, 1, "x"), (3, " \n\t ", "en", "s", 4, 1, 1, "x"), (4, long_text, "en", "s", len(long_text), 1, 1, "x"),
        (5, "Same text here twice. Same text here twice.\nSame text here twice.", "en", "s", 5, 1, 1, "x"), (5, "Same text here twice. Same text here twice.\nSame text here twice.", "en", "s", 5, 1, 1, "x"),
        (6, "Same text here twice. Same text here twice.\nSame text here twice.", "de", None, 5, None, None, None), (None, "no id at all but words", "fr", "t", 3, 1, 1, "x"), (7, "one", None, "t", None, 1, 1, "x"), (8, "ÄÖÜ é 漢字 \U0001f600 x", "de", "t", 1, 1, 1, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, label string").cache()


@pytest.fixture(scope="session")
def empty_docs(edge_docs):
    return edge_docs.where("false")


@pytest.fixture(scope="session")
def edge_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (5, 0, 1), (5, 1, 0), (4, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


def as_set(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=str)
