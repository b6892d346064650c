import random

import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline as cp
from knowloom.llm import near_copies as nc, shared
from llm_brute import brute_print
from test_simhash_ball import variants


def sets_of(text):
    own = text.lower().split()
    return {" ".join(own[k : k + 5]) for k in range(max(1, len(own) - 4))}


def share(a, b):
    a, b = sets_of(a), sets_of(b)
    return len(a & b) / len(a | b)


def test_edited_copies_go_though_their_simhash_is_far(spark, docs_of, words, sf_dir):
    rng = random.Random(6)
    rows, gone, far = [], set(), 0
    for k in range(40):
        text = words(200)
        near = text
        for _ in range(3):
            near = variants(near, words, rng, 1)[0]
        apart = text
        for _ in range(14):
            apart = variants(apart, words, rng, 1)[0]
        assert share(text, near) >= 0.8 > share(text, apart)
        far += (brute_print(text) ^ brute_print(near)).bit_count() > 4
        rows += [(k, text), (100 + k, near), (200 + k, apart)]
        gone |= {100 + k} | ({200 + k} if share(near, apart) >= 0.8 else set())
    assert far > 10
    left = {r.doc_id for r in cp.near_duplicates(spark, docs_of(rows), sf_dir).collect()}
    assert left == {i for i, _ in rows} - gone


def test_alike_equals_all_pairs():
    rng = np.random.default_rng(2)
    base = [np.arange(k * 100, k * 100 + 50, dtype=np.uint64) for k in range(4)]
    sets = [np.setdiff1d(s, rng.choice(s, int(rng.integers(0, 12)), replace=False)) for s in base * 8]
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])):
                label = [label[b] if x == label[a] else x for x in label]
    a, b = nc.alike(sets)
    got = list(range(len(sets)))
    for p, q in zip(a.tolist(), b.tolist()):
        got = [got[q] if x == got[p] else x for x in got]
    assert all((got[p] == got[q]) == (label[p] == label[q]) for p in range(len(sets)) for q in range(len(sets)))


def test_odd_rows(docs_of, words):
    a = words(300)
    rows = [(5, a), (2, a), (2, a + " more"), (None, a), (7, ""), (8, None), (9, "one two"), (10, "One  TWO")]
    docs = docs_of(rows, ", version long, node long")
    kept = nc.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or -1, r.text) for r in kept.collect()), key=str) == sorted([(-1, a), (2, a), (7, ""), (9, "one two")], key=str)
    assert nc.keep_one(docs_of([])).count() == 0


def test_large_groups_meet_in_blocks(docs_of, words, monkeypatch):
    """A third of all texts are different near copies; tasks compare few shingles at a time and rounds take one fingerprint."""
    rng = random.Random(8)
    base = words(150)
    rows = [(k, variants(base, words, rng, 1)[0]) for k in range(120)] + [(500 + k, words(60)) for k in range(200)]
    monkeypatch.setattr(nc, "GROUP", 2_000)
    monkeypatch.setattr(nc, "ROUNDS", (1, 2, 15))
    assert {r.doc_id for r in nc.keep_one(docs_of(rows)).collect()} == {0} | {i for i, _ in rows[120:]}


def test_the_ball_brings_together_what_no_minima_do(docs_of, words, monkeypatch):
    monkeypatch.setattr(nc, "prints", lambda found: [])
    a, b = words(400), words(400)
    rows = [(1, a), (2, a + " tail"), (3, b), (4, ""), (5, None)]
    assert brute_print(a) != brute_print(a + " tail") and share(a, a + " tail") >= 0.8
    assert {r.doc_id for r in nc.keep_one(docs_of(rows)).collect()} == {1, 3, 4}


def test_only_texts_that_meet_move(spark, docs_of, words):
    """Rows are told apart where they are read: no text is in a shuffle unless its ``doc_id`` may be lost or repeats."""
    near = words(200).split()
    rows = [(k, words(60)) for k in range(40)] + [(100 + k, " ".join([*near[:k], "other", *near[k + 1 :]])) for k in range(4)] + [(None, words(60)), (7, "again")]
    docs = docs_of(rows, ", may_go long")
    got = nc.keep_one(docs)
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == [*range(40), 100] and got.where("doc_id is null").count() == 1 and got.columns == docs.columns
    at = lambda c: F.xxhash64(c)
    told = shared.marked(docs, at("doc_id"), spark.createDataFrame([(3,), (101,)], "id long"), at("id"), "hit")
    assert {r.doc_id for r in told.where("hit").collect()} == {3, 101} and told.columns == [*docs.columns, "hit"] and told.count() == len(rows)
    assert shared.marked(docs, at("doc_id"), spark.createDataFrame([], "id long"), at("id"), "hit").where("hit").count() == 0
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
