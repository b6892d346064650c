import random

import numpy as np
import pytest

from knowloom.llm import prefix_trie as pt
from llm_brute import brute_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def nodes_of(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


@pytest.fixture(scope="module")
def many():
    """Conversations of few different turns, some long, one of them most of all rows."""
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "yes", "no ä", ""])) for c in range(0, 330, 3) for t in range(rng.randint(1, 7))]
    rows += [(c, t, "user", "yes") for c in (401, 402, 477) for t in range(12)]
    return rows + [(500, t, "user", f"turn {t % 5}") for t in range(700)]


@pytest.mark.parametrize("task_nodes", [8, 10_000])
def test_equals_plain_loops(spark, many, task_nodes):
    """Split by joins down to eight nodes, and finished in arrays at once."""
    short = [r for r in many if r[0] != 500 or r[1] < 60]
    got = nodes_of(pt.trie(spark.createDataFrame(short, SCHEMA), task_nodes))
    assert got == brute_trie(short)


def test_one_long_conversation_spans_ranges(spark, many):
    got = nodes_of(pt.trie(spark.createDataFrame(many, SCHEMA)).where("conv_id = 500"))
    assert {d for _, d in got} >= set(range(10, 695)) and got[500, 690][:4] == (500, 1, 1 if (500, 691) in got else 0, 1)


def test_given_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert nodes_of(pt.trie(table)) == brute_trie([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_odd_rows(spark):
    rows = [(7, None, None, None), (7, 2, "user", "b"), (7, 2, "user", "b"), (7, 2, "a", "c"), (None, 1, "user", "x"), (100, 0, "user", "long " * 20_000), (101, 0, "user", None), (-5, 3, "", "neg")]
    odd = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", depth long, fa long")
    assert nodes_of(pt.trie(odd)) == brute_trie(rows)
    only_root = [(c, 0, "user", "gone") for c in range(201, 260)]
    got = nodes_of(pt.trie(spark.createDataFrame(only_root, SCHEMA)))
    assert got == brute_trie(only_root) and any(d == 0 for _, d in got)
    assert pt.trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_running_values_cross_ranges(spark):
    from pyspark.sql import functions as F

    rows = [(1, k) for k in range(500)] + [(2, k) for k in range(3)] + [(None, 1)]
    got = pt.running(spark.createDataFrame(rows, "g long, k long"), "g", [F.col("k").asc()], None, F.col("k")).where("g is not null").collect()
    for g in (1, 2):
        own = sorted(r.k for r in got if r.g == g)
        assert {r.k: (r.r0, r.r1) for r in got if r.g == g} == {k: (i + 1, int(np.bitwise_xor.reduce(own[: i + 1]))) for i, k in enumerate(own)}


def test_forest_sums_by_centroids():
    rng = np.random.default_rng(1)
    for shape in ("chain", "random", "star"):
        n = 400
        up = {"chain": np.maximum(np.arange(n) - 1, 0), "star": np.where(np.arange(n) % 50 == 0, np.arange(n), 0), "random": np.array([0, *[rng.integers(0, k) for k in range(1, n)]])}[shape]
        depth, weight, value = np.zeros(n, np.int64), rng.integers(1, 5, n), rng.integers(0, 9, n)
        want, mass = value.copy(), weight.copy()
        for k in range(n):
            depth[k] = 0 if up[k] == k else depth[up[k]] + 1
        for k in range(n - 1, -1, -1):
            if up[k] != k:
                want[up[k]] += want[k]
                mass[up[k]] += mass[k]
        got = [np.zeros(n, np.int64)]
        pt.decompose(up, depth, mass, [value], got)
        assert np.array_equal(got[0], want)
