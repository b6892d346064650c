"""Nearest neighbours from cells against plain distances: clusters, ties, large values, lengths that differ."""

import numpy as np
import pytest

from knowloom.operators import retrieval as rt, vector_cells as vc

ORG = "organization_id"


def tables(spark, chunks, asked):
    c = spark.createDataFrame([(o, i, v.tolist()) for o, i, v in chunks], f"{ORG} string, chunk_id string, embedding array<float>")
    return c, spark.createDataFrame([(o, q, v.tolist()) for o, q, v in asked], f"{ORG} string, query_id int, embedding array<float>")


def plain(chunks, asked, k):
    out = {}
    for o, q, v in asked:
        own = sorted((round(float(((w.astype(np.float32).astype(float) - v.astype(np.float32).astype(float)) ** 2).sum()), 6), i) for p, i, w in chunks if p == o and len(w) == len(v))
        out[o, q] = own[:k]
    return out


@pytest.mark.parametrize("scale, k", [(1.0, 7), (1.0, 500), (300.0, 3)])
def test_equals_plain_distances(spark, monkeypatch, scale, k):
    monkeypatch.setattr(vc, "CELL", 10)
    monkeypatch.setattr(vc, "SEGMENT_BYTES", 8 * 6 * 50)
    monkeypatch.setattr(vc, "QUESTIONS", 4)
    rng = np.random.default_rng(1)
    middle = rng.normal(0, 5, (8, 6))
    vectors = lambda n: scale * np.round(middle[rng.integers(0, 8, n)] + rng.normal(0, 0.2, (n, 6)), 1)
    chunks = [(o, f"c{i:03d}", v) for o in ("a", "b") for i, v in enumerate(vectors(150))] + [("a", "odd", np.ones(3)), ("a", "none", np.ones(0))]
    asked = [(o, i, v) for o in ("a", "b", "nobody") for i, v in enumerate(vectors(9))] + [("a", 90, np.zeros(3)), ("a", 91, np.zeros(9))]
    got = {}
    for r in rt.knn(*tables(spark, chunks, asked), k=k).collect():
        got.setdefault((r[ORG], r["query_id"]), []).append((r["vector_rank"], r["distance"], r["chunk_id"]))
    for key, want in plain(chunks, asked, k).items():
        own = sorted(got.get(key, []))
        assert [c for _, _, c in own] == [c for _, c in want] or scale > 1 and [round(d, 2) for _, d, _ in own] == [round(d, 2) for d, _ in want]


def test_far_cells_are_not_looked_at(spark, monkeypatch):
    """Clusters far apart: the bound that the cells give leaves one cluster a question."""
    monkeypatch.setattr(vc, "CELL", 20)
    rng = np.random.default_rng(3)
    chunks = [("o", f"c{k}-{i}", np.full(4, 100.0 * k) + rng.normal(0, 0.1, 4)) for k in range(10) for i in range(60)]
    c, q = tables(spark, chunks, [("o", 1, np.full(4, 300.0))])
    found = vc.nearest(vc.build(c.coalesce(1)), q, 5).collect()
    assert len(found) == 5 and all(r["chunk_id"].startswith("c3-") for r in found)


def test_one_pass_however_many_questions(spark):
    chunks = [("o", str(i), np.ones(2) * i) for i in range(50)]
    c, q = tables(spark, chunks, [("o", i, np.ones(2) * i) for i in range(40)])
    plan = rt.knn(vc.build(c), q)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Cartesian" not in plan and "NestedLoop" not in plan
    assert rt.knn(c.limit(0), q).count() == 0 and rt.knn(c, q.limit(0)).count() == 0
