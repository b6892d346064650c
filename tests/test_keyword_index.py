"""The stored keyword index against plain scores, with pruning, many segments and many blocks of questions."""

import random

import numpy as np
import pytest

from knowloom.operators import keyword_index as ki, retrieval as rt
from test_retrieval import ORG, plain_bm25


@pytest.fixture(scope="module")
def many():
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(200)] + ["é", "x_1"]
    pick = lambda n: " ".join(words[min(int(rnd.paretovariate(0.7)), len(words)) - 1] for _ in range(n))
    docs = {o: [(f"{o}{i:04d}", pick(rnd.randint(0, 40))) for i in range(400)] for o in ("a", "b")}
    return docs, [(o, i, pick(rnd.randint(1, 9))) for o in ("a", "b") for i in range(30)]


def tables(spark, docs, asked):
    chunks = spark.createDataFrame([(o, i, t) for o, d in docs.items() for i, t in d], f"{ORG} string, chunk_id string, text string")
    return chunks, spark.createDataFrame(asked, f"{ORG} string, query_id int, query_text string")


@pytest.mark.parametrize("block, questions, k", [(128, 2000, 5), (4, 7, 5), (4, 2000, 1), (128, 2000, None)])
def test_best_of_a_stored_index(spark, many, monkeypatch, block, questions, k):
    docs, asked = many
    monkeypatch.setattr(ki, "QUESTIONS", questions)
    chunks, queries = tables(spark, docs, asked)
    index = ki.build(chunks.repartition(5), block=block)
    got = {}
    for r in rt.bm25(index, queries, k=k).collect():
        got.setdefault((r[ORG], r["query_id"]), []).append((r["keyword_rank"], r["chunk_id"], r["keyword_score"]))
    for o, q, text in asked:
        want = sorted(plain_bm25(docs[o], text).items(), key=lambda x: (-x[1], x[0]))[:k]
        own = sorted(got.get((o, q), []))
        assert len(own) == len(want) and [r for r, _, _ in own] == list(range(1, len(want) + 1))
        assert all(abs(s - w) < 2e-6 for (_, _, s), (_, w) in zip(own, want))


def test_pruning_gives_the_same_chunks():
    rng = np.random.default_rng(2)
    n, lengths = 3000, rng.integers(1, 60, 3000)
    lists = []
    for weight, share in ((6.0, 0.003), (4.0, 0.02), (0.2, 0.6), (0.1, 0.9), (-0.05, 0.5)):
        docs = np.flatnonzero(rng.random(n) < share)
        often = rng.integers(1, 5, len(docs))
        at = np.arange(0, len(docs), 16)
        heads = np.stack([docs[np.minimum(at + 16, len(docs)) - 1], np.maximum.reduceat(often, at), np.minimum.reduceat(lengths[docs], at)]).astype("<i4")
        row = {"docs": docs.astype("<i4").tobytes(), "often": often.astype("<i4").tobytes(), "heads": heads.tobytes()}
        lists.append((weight, ki._List(row, lengths, lengths.mean())))
    order = rng.permutation(n)
    whole, scores = ki.best(lists, n, order, None)
    for _, p in lists:
        p.made = None
    docs, own = ki.best(lists, n, order, 10)
    assert docs.tolist() == whole[:10].tolist() and np.array_equal(own, scores[:10])


def test_one_exchange_between_postings_and_ranks(spark, many):
    """Chunks are read and tokenised once, while the index is built; a search reads postings alone."""
    chunks, queries = tables(spark, *many)
    index = ki.build(chunks)
    plan = rt.bm25(index, queries)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all(lower(text" not in plan.replace("query_text", "") and plan.count("FlatMapGroupsInArrow") == 1 and "Cartesian" not in plan
    again = rt.bm25(index, queries.where("query_id < 3"))
    assert {r["query_id"] for r in again.collect()} <= {0, 1, 2}


def test_no_chunks_no_questions_no_words(spark, many):
    chunks, queries = tables(spark, *many)
    assert rt.bm25(chunks.limit(0), queries).count() == 0 and rt.bm25(chunks, queries.limit(0)).count() == 0
    empty = spark.createDataFrame([("o", "c", ""), ("o", "d", None), ("o", "e", "word other")], f"{ORG} string, chunk_id string, text string")
    got = rt.bm25(empty, spark.createDataFrame([("o", 1, "word"), ("o", 2, ""), ("o", 3, None)], f"{ORG} string, query_id int, query_text string")).collect()
    assert [(r["query_id"], r["chunk_id"]) for r in got] == [(1, "e")]


@pytest.mark.parametrize("block", [1, 3, 128])
def test_columns_of_a_segment_equal_plain_loops(block):
    import pyarrow as pa

    rnd = random.Random(block)
    texts = [[f"w{min(int(rnd.paretovariate(0.6)), 40)}" for _ in range(rnd.randint(0, 30))] for _ in range(50)] + [[], ["é"]]
    ints = lambda b: np.frombuffer(b, "<i4").tolist()
    for own in (texts, [[]], [["a"]], [[], []]):
        rows = list(zip(*[c.to_pylist() for c in ki._postings(pa.array(own, pa.list_(pa.string())), pa.array([f"c{k}" for k in range(len(own))]), block)]))
        term, n, total, heads, docs, often, ids = rows[0]
        assert (term, n, total, heads, often) == (None, len(own), sum(map(len, own)), None, None) and ints(docs) == [len(x) for x in own] and ids == [f"c{k}" for k in range(len(own))]
        assert [r[0] for r in rows[1:]] == sorted({w for x in own for w in x})
        for term, n, total, heads, docs, often, ids in rows[1:]:
            held = [(k, x.count(term), len(x)) for k, x in enumerate(own) if term in x]
            cut = [held[a : a + block] for a in range(0, len(held), block)]
            assert (n, total, ids) == (len(held), None, None) and ints(docs) == [k for k, _, _ in held] and ints(often) == [f for _, f, _ in held]
            assert ints(heads) == [c[-1][0] for c in cut] + [max(f for _, f, _ in c) for c in cut] + [min(z for _, _, z in c) for c in cut]
