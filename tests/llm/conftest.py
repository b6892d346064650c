"""Small tables with awkward rows, as Spark frames."""

from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Rows of ``documents`` from ``(doc_id, text)`` pairs; texts may be null."""

    def make(rows, extra=""):
        full = [(i, t, "en", "src", None if t is None else len(t)) + ((7,) * extra.count(",")) for i, t in rows]
        return spark.createDataFrame(full, DOCS + extra)

    return make


@pytest.fixture(scope="session")
def words():
    """A seeded maker of made-up sentences."""
    import random

    rng = random.Random(5)
    syllables = "an the ing ou er re st nd th on ti ea sh ha wh".split()

    def make(n):
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))

    return make
