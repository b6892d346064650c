"""Reranking models: loaded once per worker, failing on some batches, refused without a model."""

import pytest

from knowloom.operators import mapping as mp, providers, retrieval as rt

KEYS = ["organization_id", "query_id"]


def makers():
    """Loaders made here, so that they travel to the workers by value."""
    def by_length():
        def model(queries, texts):
            if any("broken" in t for t in texts):
                raise RuntimeError("no")
            return [float(len(t)) if t != "unknown" else float("nan") for t in texts]

        return model

    def not_there():
        raise OSError("no weights")

    return by_length, not_there


by_length, not_there = makers()


def pool(spark, texts):
    rows = [("o", 1, f"c{k}", k + 1, "q", t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "organization_id string, query_id int, chunk_id string, rrf_rank int, query_text string, text string").coalesce(1)


def ranked(spark, texts, load):
    out = rt.rerank(pool(spark, texts), KEYS, "model", providers.model_scores(load)).orderBy("final_rank").collect()
    return [(r["chunk_id"], r["rerank_score"]) for r in out]


def test_scores_order_the_pool_and_a_failed_batch_keeps_its_order(spark):
    assert ranked(spark, ["a", "bbb", "unknown", "cc"], by_length) == [("c1", 3.0), ("c3", 2.0), ("c0", 1.0), ("c2", None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert ranked(spark, ["a", "broken", "x", "yyyy"], by_length) == [("c3", 4.0), ("c2", 1.0), ("c0", None), ("c1", None)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert ranked(spark, ["a", "bb"], not_there) == [("c0", None), ("c1", None)]


def test_a_model_provider_needs_a_model(spark):
    with pytest.raises(ValueError):
        rt.rerank(pool(spark, ["a"]), KEYS, "model")
    found = spark.createDataFrame([("o", "r", 1, "c", 1)], "organization_id string, repository_id string, query_id int, chunk_id string, position int")
    with pytest.raises(ValueError):
        mp.rerank_candidates(found, score_udf=providers.model_scores(by_length))


def test_mapping_with_a_model_reads_its_own_texts(spark):
    scope = "organization_id string, repository_id string"
    found = spark.createDataFrame([("o", "r", 1, f"c{k}", k + 1) for k in range(3)], f"{scope}, query_id int, chunk_id string, position int")
    asked = spark.createDataFrame([("o", "r", 1, "need")], f"{scope}, query_id int, query_text string")
    chunks = spark.createDataFrame([("o", "r", "c0", "unknown"), ("o", "r", "c1", "x" * 900), ("o", "r", "c2", "yy"), ("p", "r", "c2", "other tenant")], f"{scope}, chunk_id string, text string")
    out = mp.rerank_candidates(found, score_udf=providers.model_scores(by_length), requirements=asked, chunks=chunks)
    assert {r["chunk_id"]: r["rerank_score"] for r in out.collect()} == {"c0": 1.0, "c1": 405.0, "c2": 2.0}
    assert out.columns == [*found.columns, "rerank_score"]
