"""Fixtures of the corpus operators: a table of odd documents."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, component_id long, `a.b` string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing extra columns."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [
        (1, words, "en", "web"), (2, words, "en", "web"), (2, words, "en", "web"), (None, words, "en", None),
        (3, None, "en", "web"), (4, "", None, "books"), (5, " \t\n ", "en", None), (6, "word", None, None),
        (7, "123 456 !!", "en", "books"), (None, None, None, None), (None, None, None, None),
        (8, "lorem ipsum dolor\n" * 5000, "fr", "books"), (9, "é" * 30000, "fr", "web"), (10, words.upper(), "de", "web"),
    ]
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "x") for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
