import math

import numpy as np
import pytest

from knowloom.llm import pivot_join as pj

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, dim):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids = np.array([i for i, _ in good])
    x = np.array([v / np.linalg.norm(v) for _, v in good]).reshape(-1, dim)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(near, low[None, :], 1 << 60).min(axis=1, initial=1 << 60))
        if (new == low).all():
            return {int(i): (int(n), int(c)) for i, n, c in zip(ids, near.sum(axis=1), low)}
        low = new


def random_rows(n, seed=0, dim=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 6, dim))
    x = np.concatenate([base, base[: n // 6] + rng.normal(size=(n // 6, dim)) * 0.25, np.repeat(base[:1], n // 3, axis=0) + rng.normal(size=(n // 3, dim)) * 0.1, np.repeat(base[1:2], n // 6, axis=0), rng.normal(size=(n // 6, dim))])
    order = rng.permutation(len(x))
    return [(int(k), [float(v) for v in x[j].astype(np.float32)], 1) for k, j in enumerate(order)]


@pytest.mark.parametrize("cell, block", [(4000, 4000), (60, 25)])
def test_equals_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(pj, "CELL", cell)
    monkeypatch.setattr(pj, "BLOCK", block)
    rows = random_rows(600)
    want = brute(rows, 8)
    got = pj.near_duplicates(spark.createDataFrame(rows, ROWS)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id) == want[r.vec_id] and r.kept == (r.vec_id == r.component_id)


def test_visits_lose_no_pair():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    radius = math.sqrt(2 - 1.8)
    d = pj.distances(x, x[:12])
    home = d.argmin(axis=1)
    far = np.array([d[home == c, c].max(initial=-1) for c in range(12)])
    home, visit = pj.visits(d, radius, far)
    for a, b in np.argwhere(np.triu(x @ x.T >= 0.9, 1)):
        low, high = sorted((a, b), key=lambda k: home[k])
        assert home[low] == home[high] or visit[high, home[low]]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.1]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (12, [-0.0, 1.0]), (13, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<float>, kept int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pj.near_duplicates(df).collect()}
    for k in (1, 2, 3, 4, 5, 6, 10):
        assert got[k] == (0, k, True)
    assert got[7] == (2, 7, True) and got[8] == (2, 7, False) and got[9] == (2, 7, False) and got[None] == (0, None, False)
    assert got[12] == (1, 12, True) and got[13] == (1, 12, False)


def test_repeated_rows_doubles_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, -1.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, pj.near_duplicates(df).collect())) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]
    assert pj.near_duplicates(df.limit(0)).count() == 0
    assert [tuple(r) for r in pj.near_duplicates(spark.createDataFrame([(5, None)], ROWS.split(", label")[0])).collect()] == [(5, 0, 5, True)]


@pytest.mark.parametrize("cell, block", [(4000, 4000), (60, 25)])
def test_every_length_is_joined(spark, monkeypatch, cell, block):
    monkeypatch.setattr(pj, "CELL", cell)
    monkeypatch.setattr(pj, "BLOCK", block)
    parts = {8: random_rows(300), 5: random_rows(120, 1, 5), 3: random_rows(18, 2, 3), 2: [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)]}
    rows, want = [], {}
    for dim, own in parts.items():
        own = [(1000 * dim + i, v, x) for i, v, x in own]
        rows += own
        want |= brute(own, dim)
    got = {r.vec_id: (r.n_links, r.component_id) for r in pj.near_duplicates(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == want and got[2001] == (1, 2000)
