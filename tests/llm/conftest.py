"""Fixtures of these tests."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and a column that clashes."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(40_000))
    same = " ".join(rng.choice(words) for _ in range(60))
    rows = [(1, same, "en", "s", 1), (2, same, "en", None, None), (2, same, "en", None, None), (3, None, None, "s", 0), (4, "", "en", "s", 0), (5, long, None, "s", 1), (6, same + " end", "de", "s", 1), (None, same, "en", "s", 1), (7, "-- 12 --", "en", "s", 1)]
    return spark.createDataFrame([(*r, "x", 0) for r in rows], DOCS + ", words string, key long")
