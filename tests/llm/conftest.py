from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, taken long, __id long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, source]) rows, with columns whose names clash with inner ones."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), -1, -2, -3) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and white texts, repeats of rows and ids, ties, one very long text."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    long = prose(30_000)
    base = prose(120)
    rows = [(1, None, None), (2, "", "b"), (3, " \n\t ", "b"), (4, "one", "a"), (5, base, "a"), (5, base, "a"), (6, base, "b"), (7, base + " tail", "c"), (8, long, "c"), (None, prose(60), "a"), (9, prose(60) + " é ü 😀", None), (-3, "x " * 500, "d")]
    rows += [(100 + i, prose(rng.randint(1, 150)), "abcd"[i % 4]) for i in range(60)]
    return rows
