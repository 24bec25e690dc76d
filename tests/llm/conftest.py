from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and further columns
    with names the operators use themselves."""
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again", "en", "a", 1),
        (1, "The quick brown fox jumps over the lazy dog again", "en", "a", 1),
        (2, "The quick brown fox jumps over the lazy dog again", "en", None, None),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \t\n", None, "b", 0),
        (None, "Le renard brun saute par dessus le chien", "fr", "b", 1),
        (None, None, "fr", None, None),
        (6, long, "en", "c", 1),
        (7, long + " end", "en", "c", 1),
        (8, "12 34 !!", "de", "d", 1),
        (9, "Съешь же ещё этих мягких булок", None, "a", 1),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    clash = {c: docs["n_chars"] for c in ("size", "copies", "target", "row", "key", "fp", "doc")}
    clash |= {c: docs["source"] for c in ("found", "shard", "slot", "h1", "_text_key", "SCORE")}
    return docs.withColumns(clash)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
