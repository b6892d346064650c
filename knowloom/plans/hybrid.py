"""Hybrid search end to end: both rankings, fusion, pool, rerank, page, context, prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import head_tail
from ..operators import graph, retrieval as rt
from ..operators.providers import stub_answer

ORG = "organization_id"
KEYS = [ORG, "query_id"]


def fuse(chunks: DataFrame, queries: DataFrame, embedded: DataFrame, limit: int = 10, offset: int = 0, min_score: float = 0.0) -> DataFrame:
    """Fused ranking of every query; the cut-offs grow with the asked page.

    ``min_score`` drops vector hits before they take part in the fusion; keyword hits are left alone.
    """
    n = max(limit + offset, rt.VECTOR_TOP)
    near = rt.knn(embedded, queries, [ORG], n)
    near = near.select(*KEYS, "chunk_id", rt.similarity("distance").alias("similarity_score"), "vector_rank")
    if min_score > 0:
        near = near.where(F.col("similarity_score") >= min_score)  # distances are ranked, so the ranks that stay are dense
    words = rt.bm25(chunks, queries.select(ORG, "query_id", "query_text"), [ORG], max(n, rt.KEYWORD_TOP))
    return rt.reciprocal_rank_fusion(near, words, KEYS)


def search(chunks: DataFrame, queries: DataFrame, embedded: DataFrame, limit: int = 10, offset: int = 0, provider: str = "stub",
           min_score: float = 0.0, score_udf=None) -> DataFrame:
    """One page per query: (org, query_id, final_rank, chunk_id, scores, ranks, total_results).

    With a ``score_udf(query_text, text)`` the pool is reranked by that model on head and tail of the chunk.
    """
    pool = rt.rerank_pool(fuse(chunks, queries, embedded, limit, offset, min_score), limit, offset)
    if score_udf is not None:
        provider = "model"
        pool = pool.join(queries.select(*KEYS, "query_text"), KEYS).join(
            chunks.select(ORG, F.col("chunk_id").cast("string").alias("chunk_id"), head_tail("text").alias("text")), [ORG, "chunk_id"])
    return rt.page(rt.rerank(pool, KEYS, provider, score_udf), KEYS, limit, offset)


def prompts(page: DataFrame, chunks: DataFrame, queries: DataFrame, top_k: int = 5, excerpt: int = 300) -> DataFrame:
    """Prompt, stub answer and cited sources of each query from its first ``top_k`` results."""
    few = page.where(F.col("final_rank") <= top_k).join(chunks.select(ORG, "chunk_id", "filename", "text"), [ORG, "chunk_id"])
    item = F.format_string("[Excerpt %d] %s\n%s", "final_rank", "filename", "text")
    per_query = few.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("final_rank", item.alias("s"), "filename", F.left("text", F.lit(excerpt)).alias("snippet")))).alias("_x"))
    out = queries.join(per_query, KEYS)
    body = F.array_join(F.transform("_x", lambda x: x["s"]), "\n\n")
    return out.select(
        *KEYS, F.concat(F.lit("Question: "), "query_text", F.lit("\n\n"), body).alias("prompt"),
        stub_answer("query_text", F.size("_x")).alias("answer"),
        F.transform("_x", lambda x: F.struct(x["filename"].alias("filename"), x["snippet"].alias("snippet"))).alias("sources"))


def with_context(page: DataFrame, chunks: DataFrame, files: DataFrame, owns: DataFrame, documents: DataFrame) -> DataFrame:
    """Result rows with the graph context of their file; only files on the page are expanded.

    ``chunks`` brings file_id, or what it derives from (module_id and file_path), per chunk_id.
    """
    given = F.col("file_id") if "file_id" in chunks.columns else None
    named = chunks.select(ORG, "chunk_id", rt.file_id_of("module_id", "file_path", given).alias("file_id"))
    rows = page.join(named, [ORG, "chunk_id"], "left")
    context = graph.expand_code(rows.where(F.col("file_id").isNotNull()), files, owns, documents)
    return rows.join(context, [ORG, "file_id"], "left")
