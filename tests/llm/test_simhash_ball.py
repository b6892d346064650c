import random

import numpy as np
import pytest

from knowloom.llm import simhash_ball as sb
from llm_brute import brute_components, brute_print


def variants(text, words, rng, n):
    parts = text.split()
    out = []
    for _ in range(n):
        own = list(parts)
        own[rng.randrange(len(own))] = words(1)
        out.append(" ".join(own))
    return out


def test_prints_and_groups_equal_brute_force(docs_of, words):
    rng = random.Random(2)
    base = [words(n) for n in (1, 3, 4, 5, 60, 200, 400)]
    texts = [None, "", "  \n", " ", *base, *base[:3], *(v for b in base[4:] for v in variants(b, words, rng, 6)), "A b C d E", "a B c D e", words(20_000)]
    rows = {r.doc_id: r for r in sb.near_duplicates(docs_of(list(enumerate(texts)), ", fp long, component_id long")).collect()}
    prints = [brute_print(t) for t in texts]
    assert [rows[k].fp & (1 << 64) - 1 for k in range(len(texts))] == prints
    assert [rows[k].component_id for k in range(len(texts))] == brute_components(prints, range(len(texts)))


@pytest.mark.parametrize("bits, limit", [(0, 3_000_000), (5, 3_000_000), (3, 2_000)])
def test_meeting_finds_every_link(monkeypatch, bits, limit):
    monkeypatch.setattr(sb, "BUCKET_VARIANTS", limit)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    near = [base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k, 60)).astype(np.uint64), axis=0) for k in (1, 2, 3, 4, 5, 4)]
    x = np.unique(np.concatenate([base, *near]))
    ball, edges = sb.Ball(bits, 2), []
    for bucket in range(1 << bits):
        for part, name in ball.finer(x, bucket):
            a, b = sb.meet(part, x, name, 4)
            edges += zip(np.searchsorted(x, a.view(np.uint64)).tolist(), np.searchsorted(x, b.view(np.uint64)).tolist())
    root = list(range(len(x)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert [find(k) for k in range(len(x))] == brute_components(x, range(len(x)))


def test_odd_rows_are_grouped(docs_of, words):
    a, b = words(300), words(300)
    rows = [(5, a), (2, a), (9, b), (2, a + " more"), (None, a), (7, ""), (8, None)]
    got = sb.near_duplicates(docs_of(rows, ", fp long, component_id long")).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, 2), (2, 2), (2, 2), (5, 2), (7, 7), (8, 7), (9, 9)]
    assert sb.near_duplicates(docs_of([])).count() == 0


def test_odd_radius_is_refused(docs_of):
    with pytest.raises(ValueError):
        sb.near_duplicates(docs_of([(1, "a")]), radius=3)
