"""Rows that every operator has to bear."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like results."""
    plain = " ".join(f"word{k} the of" for k in range(40))
    rows = [
        (1, plain, "en", "a", 5), (1, plain, "en", "a", 5), (2, plain, None, "a", None), (3, "", "en", None, 0), (4, None, "en", "b", None),
        (None, plain + " more", "en", "b", 1), (5, "x", "en", "b", 1), (6, " \t\n ", "en", "b", 3), (7, "Ünï çödé 你好 🙂 " * 30, "en", "ß", 1),
        (8, "long " + " ".join(f"w{k % 9973}" for k in range(60_000)), "en", "a", 1), (-9, "a b c d e f g h " * 20, "en", "a", 1),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("kept", "copies", "taken", "target", "size", "n", "k", "d", "key", "id", "t", "r", "i", "sequence_id", "component_id", "term", "n_words"):
        frame = frame.selectExpr("*", f"'x' AS {name}")
    return frame


@pytest.fixture(scope="session")
def documents_on_disk(spark, odd_documents, tmp_path_factory):
    """The same from files, as operators that read twice need."""
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    odd_documents.repartition(3, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
