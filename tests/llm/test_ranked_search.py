import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from knowloom.functions.packing import pack, unpack
from knowloom.llm import ranked_search as rs

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    own = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in own:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def table_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="module")
def many():
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(300)] + ["Straße", "東京", "x"]
    pick = lambda n: " ".join(vocabulary[min(int(rng.paretovariate(0.6)), len(vocabulary)) - 1] for _ in range(n))
    docs = [(k, pick(rng.randint(1, 60))) for k in range(900)] + [(k, "the same text w5 w9") for k in range(2000, 2300)]
    return docs, [(k, pick(rng.randint(1, 12))) for k in range(40)] + [(50, "same w9 w9 the")]


@pytest.mark.parametrize("block, postings, window", [(128, 1_000_000, 4096), (4, 700, 16), (1, 50, 3)])
def test_equals_scores_of_all_documents(spark, docs_of, many, block, postings, window):
    """Also with many segments, blocks and windows, where lists and blocks are passed over."""
    docs, items = many
    index = rs.build(docs_of(docs), block, postings)
    got = rs.search(index, table_of(spark, items), 20, window).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items, 20)


def test_blocks_without_a_chance_stay_packed(many):
    docs, items = many
    read = {}
    for k in (3, len(docs)):
        segment = rs.Segment()
        for i, t in docs:
            segment.add(i, Counter(rs.terms_of(t)))
        rows = segment.close(0, 4).to_pylist()
        lengths, n, total = unpack(rows[0]["blocks"]), len(docs), rows[0]["total"]
        assert rs.unpacked_ids(rows[0]["postings"]) == [i for i, _ in docs] and lengths.sum() == total
        impact = lambda often, length: 1_000_000_000 * often // (1000 * often + 12 * (75 + 25 * length * n // total))
        own = {r["term"]: rs.Postings(r, impact, lengths) for r in rows[1:]}
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * r["n"] + 1))) for t, r in zip([r["term"] for r in rows[1:]], rows[1:])}
        for _, text in items:
            rs.best([(weight[t] * c, own[t]) for t, c in Counter(terms(text)).items() if t in own], np.arange(len(docs)), k, 64)
        read[k] = sum(1 for p in own.values() for key in p.read if not isinstance(key, tuple))
    assert read[3] < read[len(docs)]


def test_odd_rows(spark, docs_of):
    docs = [(1, None), (2, ""), (3, "..."), (4, "A b b"), (4, "A b b"), (None, "a b b"), (5, "b " * 40_000), (-6, "É é ı"), (7, "c")]
    items = [(1, "a"), (1, "a"), (1, "B!"), (2, None), (3, ""), (None, "é É"), (9, "unknown")]
    index = rs.build(docs_of(docs, ", term long, segment long"))
    got = rs.search(index, spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, rank long")).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, [(1, "a"), (1, "B!"), (None, "é É")], 20)
    assert rs.search(index, table_of(spark, [])).count() == 0
    assert rs.search(rs.build(docs_of([])), table_of(spark, items)).count() == 0


def test_blocks_of_items(spark, docs_of, many, monkeypatch):
    docs, items = many
    index = rs.build(docs_of(docs))
    monkeypatch.setattr(rs, "ITEM_CHARS", 200)
    assert sorted(map(tuple, rs.search(index, table_of(spark, items), 5).collect()), key=str) == brute(docs, items, 5)


def test_numbers_come_back():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, 1 << 40, 5])
    data, at = pack(values)
    assert np.array_equal(unpack(data), values) and np.array_equal(unpack(data[at[3] : at[5]].tobytes()), values[3:5])
    assert len(unpack(pack(np.empty(0, np.int64))[0])) == 0
