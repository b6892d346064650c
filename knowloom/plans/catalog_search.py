"""Registered queries: vector, keyword and hybrid retrieval, intents, and requirement mapping."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import mapping as mp, providers, retrieval as rt
from ..session import spread
from ..sources import warehouse as wh
from . import hybrid
from .catalog_text import SQL_CHUNKS
from .registry import query

# Independent statement of both rankings; every benchmark text is asked in every tenant.
SQL_KNN = SQL_CHUNKS + """, asked AS (
  SELECT l.lang AS organization_id, b.item_id AS query_id, b.text AS query_text FROM benchmark b, (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) l),
qvec AS (SELECT a.organization_id, a.query_id, e.embedding AS q FROM asked a JOIN embeddings e ON e.vec_id = a.query_id),
cvec AS (SELECT c.organization_id, c.chunk_id, e.embedding AS v FROM chunk_text c JOIN embeddings e ON e.vec_id = c.doc_id),
dist AS (SELECT organization_id, query_id, chunk_id,
    round(list_sum(list_transform(list_zip(q, v), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 6) AS distance
  FROM qvec JOIN cvec USING (organization_id)),
knn AS (SELECT *, row_number() OVER (PARTITION BY organization_id, query_id ORDER BY distance, chunk_id) AS vector_rank FROM dist
  QUALIFY vector_rank <= 50)
"""


def sql_bm25(chunks: str, asked: str, scope: str, top: int) -> str:
    """Okapi statements over ``chunks`` (scope, chunk_id, text) and ``asked`` (scope, query_id, query_text)."""
    on = " AND ".join(f"a.{c} = b.{c}" for c in scope.split(", "))
    return f"""
tok AS (SELECT {scope}, chunk_id, regexp_extract_all(lower(text), '[\\pL\\pN_]+') AS t FROM {chunks}),
stat AS (SELECT {scope}, count(*) AS n, avg(len(t)) AS avgdl FROM tok GROUP BY {scope}),
post AS (SELECT {scope}, chunk_id, len(t) AS dl, unnest(t) AS term FROM tok),
tf AS (SELECT {scope}, chunk_id, dl, term, count(*) AS tf FROM post GROUP BY ALL),
dfs AS (SELECT {scope}, term, count(*) AS df FROM tf GROUP BY ALL),
raw AS (SELECT a.*, b.n, b.avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM dfs a JOIN stat b ON {on}),
lift AS (SELECT {scope}, 0.25 * avg(r) AS floor_idf FROM raw GROUP BY {scope}),
idf AS (SELECT a.*, CASE WHEN r < 0 THEN floor_idf ELSE r END AS idf FROM raw a JOIN lift b ON {on}),
qt AS (SELECT {scope}, query_id, term, count(*) AS w FROM (
    SELECT {scope}, query_id, unnest(regexp_extract_all(lower(query_text), '[\\pL\\pN_]+')) AS term FROM {asked}) GROUP BY ALL),
qi AS (SELECT a.*, b.idf, b.avgdl FROM qt a JOIN idf b ON {on} AND a.term = b.term),
kscore AS (SELECT a.{scope.replace(', ', ', a.')}, b.query_id, a.chunk_id,
    round(sum(b.w * b.idf * a.tf * 2.5 / (a.tf + 1.5 * (0.25 + 0.75 * a.dl / b.avgdl))), 6) AS keyword_score
  FROM tf a JOIN qi b ON {on} AND a.term = b.term GROUP BY ALL),
kw AS (SELECT *, row_number() OVER (PARTITION BY {scope}, query_id ORDER BY keyword_score DESC, chunk_id) AS keyword_rank
  FROM kscore WHERE keyword_score > 0 QUALIFY keyword_rank <= {top})
"""


SQL_BOTH = SQL_KNN + "," + sql_bm25("chunk_text", "asked", "organization_id", 100) + """, fused AS (
  SELECT coalesce(k.organization_id, w.organization_id) AS organization_id, coalesce(k.query_id, w.query_id) AS query_id,
    coalesce(k.chunk_id, w.chunk_id) AS chunk_id, vector_rank, keyword_rank, distance, keyword_score,
    round(coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + keyword_rank), 0), 6) AS rrf_score
  FROM knn k FULL OUTER JOIN kw w ON k.organization_id = w.organization_id AND k.query_id = w.query_id AND k.chunk_id = w.chunk_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY organization_id, query_id ORDER BY rrf_score DESC, chunk_id) AS rrf_rank FROM fused)
"""


@query("r2_knn", SQL_KNN + "SELECT organization_id, query_id, chunk_id, distance, vector_rank::INT AS vector_rank FROM knn")
def nearest(spark, sf):
    return rt.knn(wh.embedded_chunks(spark, sf), wh.tenant_queries(spark, sf, True))


@query("r3_similarity", SQL_KNN + """
SELECT organization_id, query_id, chunk_id, round(greatest(0, 1 - distance), 4) AS similarity_score, vector_rank::INT AS vector_rank
FROM knn WHERE round(greatest(0, 1 - distance), 4) >= 0.02""")
def similar(spark, sf):
    near = rt.knn(wh.embedded_chunks(spark, sf), wh.tenant_queries(spark, sf, True))
    return near.select("organization_id", "query_id", "chunk_id", rt.similarity("distance").alias("similarity_score"), "vector_rank").where(
        F.col("similarity_score") >= 0.02)


@query("r4_merged_ranks", SQL_KNN + """, c AS (SELECT organization_id, query_id, chunk_id, distance, row_number() OVER (PARTITION BY organization_id, query_id, split_part(chunk_id, ':', 1)::INT % 2 ORDER BY distance, chunk_id) AS r FROM dist),
m AS (SELECT *, split_part(chunk_id, ':', 1)::INT % 2 AS kind, round(greatest(0, 1 - distance), 4) AS score FROM c WHERE r <= 50)
SELECT organization_id, query_id, chunk_id, score AS similarity_score, CASE WHEN kind = 0 THEN 'code' ELSE 'doc' END AS result_type,
  row_number() OVER (PARTITION BY organization_id, query_id ORDER BY score DESC, kind, distance, chunk_id)::INT AS vector_rank FROM m""")
def merged(spark, sf):
    e, q = wh.embedded_chunks(spark, sf), wh.tenant_queries(spark, sf, True)
    near = lambda odd: rt.knn(e.where(F.col("source_id") % 2 == odd), q).drop("vector_rank")
    return rt.merge_collections(near(0), near(1), ["organization_id", "query_id"]).drop("distance")


@query("r2_label_centroids", """
WITH d AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, 64)) AS i FROM embeddings) GROUP BY ALL),
c AS (SELECT label, list(m ORDER BY i) AS q FROM d GROUP BY label),
s AS (SELECT c.label AS query_id, e.vec_id::VARCHAR AS chunk_id,
  round(list_sum(list_transform(list_zip(q, embedding), lambda p: (p[1] - p[2]::DOUBLE) * (p[1] - p[2]::DOUBLE))), 6) AS distance FROM c, embeddings e)
SELECT query_id, chunk_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id)::INT AS vector_rank FROM s QUALIFY vector_rank <= 50""")
def centroids(spark, sf):
    e = wh.table(spark, sf, "embeddings")
    mean = e.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
    q = mean.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("embedding"))
    one = F.lit("all").alias("organization_id")
    return rt.knn(e.select(one, F.col("vec_id").alias("chunk_id"), "embedding"), q.select(one, "query_id", "embedding")).drop("organization_id")


@query("r5_bm25", SQL_KNN + "," + sql_bm25("chunk_text", "asked", "organization_id", 100) + """
SELECT organization_id, query_id, chunk_id, keyword_score, keyword_rank::INT AS keyword_rank FROM kw""")
def keywords(spark, sf):
    return rt.bm25(wh.document_chunks(spark, sf), wh.tenant_queries(spark, sf))


@query("r6_rrf", SQL_BOTH + """
SELECT organization_id, query_id, chunk_id, rrf_score, rrf_rank::INT AS rrf_rank, coalesce(vector_rank, 0)::INT AS vector_rank,
  coalesce(keyword_rank, 0)::INT AS keyword_rank FROM ranked""")
def fused(spark, sf):
    out = hybrid.fuse(wh.document_chunks(spark, sf), wh.tenant_queries(spark, sf, True), wh.embedded_chunks(spark, sf))
    return out.select("organization_id", "query_id", "chunk_id", "rrf_score", "rrf_rank",
                      F.coalesce("vector_rank", F.lit(0)).alias("vector_rank"), F.coalesce("keyword_rank", F.lit(0)).alias("keyword_rank"))


@query("r7_pool", SQL_BOTH + """
SELECT organization_id, query_id, count(*) AS pool_size, sum(rrf_score)::DOUBLE AS pool_score FROM ranked WHERE rrf_rank <= 30 GROUP BY ALL""")
def pool(spark, sf):
    out = hybrid.fuse(wh.document_chunks(spark, sf), wh.tenant_queries(spark, sf, True), wh.embedded_chunks(spark, sf))
    return rt.rerank_pool(out, 10).groupBy("organization_id", "query_id").agg(
        F.count(F.lit(1)).alias("pool_size"), F.sum("rrf_score").alias("pool_score"))


@query("hybrid_search", SQL_BOTH + """
SELECT organization_id, query_id, chunk_id, rrf_rank::INT AS final_rank, (least(n, 30) - rrf_rank + 1)::DOUBLE AS rerank_score, rrf_score, least(n, 30) AS total_results
FROM (SELECT *, count(*) OVER (PARTITION BY organization_id, query_id) AS n FROM ranked) WHERE rrf_rank <= 10""")
def hybrid_search(spark, sf):
    page = hybrid.search(wh.document_chunks(spark, sf), wh.tenant_queries(spark, sf, True), wh.embedded_chunks(spark, sf))
    return page.select("organization_id", "query_id", "chunk_id", "final_rank", "rerank_score", "rrf_score", "total_results")


@query("hybrid_min_score", SQL_BOTH.replace("FROM knn k FULL OUTER JOIN", "FROM (SELECT * FROM knn WHERE round(greatest(0, 1 - distance), 4) >= 0.02) k FULL OUTER JOIN") + """
SELECT organization_id, query_id, chunk_id, rrf_rank::INT AS final_rank, rrf_score, least(n, 30) AS total_results
FROM (SELECT *, count(*) OVER (PARTITION BY organization_id, query_id) AS n FROM ranked) WHERE rrf_rank <= 10""")
def hybrid_min_score(spark, sf):
    page = hybrid.search(wh.document_chunks(spark, sf), wh.tenant_queries(spark, sf, True), wh.embedded_chunks(spark, sf), min_score=0.02)
    return page.select("organization_id", "query_id", "chunk_id", "final_rank", "rrf_score", "total_results")


def mixed_lengths(query: pd.Series, text: pd.Series) -> pd.Series:
    """A made-up reranking model: none for one text in seven, else the texts' lengths mixed."""
    n = text.str.len()
    return ((n * 31 + query.str.len() * 17) % 101).astype("float64").where(n % 7 != 0)


@query("hybrid_reranked", SQL_BOTH + """, pool AS (SELECT r.*, length(query_text) AS q, CASE WHEN length(c.text) <= 400 THEN length(c.text) ELSE 405 END AS n FROM ranked r JOIN asked a USING (organization_id, query_id) JOIN chunk_text c USING (organization_id, chunk_id) WHERE rrf_rank <= 30),
scored AS (SELECT *, CASE WHEN n % 7 <> 0 THEN ((n * 31 + q * 17) % 101)::DOUBLE END AS rerank_score FROM pool)
SELECT organization_id, query_id, chunk_id, rerank_score, row_number() OVER (PARTITION BY organization_id, query_id ORDER BY rerank_score DESC NULLS LAST, rrf_rank)::INT AS final_rank FROM scored QUALIFY final_rank <= 10""")
def hybrid_reranked(spark, sf):
    page = hybrid.search(wh.document_chunks(spark, sf), wh.tenant_queries(spark, sf, True), wh.embedded_chunks(spark, sf), score_udf=F.pandas_udf(mixed_lengths, "double"))
    return page.select("organization_id", "query_id", "chunk_id", "rerank_score", "final_rank")


@query("r13_page", SQL_BOTH + """
SELECT organization_id, query_id, chunk_id, rrf_rank::INT AS final_rank, least(n, 35) AS total_results
FROM (SELECT *, count(*) OVER (PARTITION BY organization_id, query_id) AS n FROM ranked) WHERE rrf_rank BETWEEN 26 AND 35""")
def third_page(spark, sf):
    page = hybrid.search(wh.document_chunks(spark, sf), wh.tenant_queries(spark, sf, True), wh.embedded_chunks(spark, sf), limit=10, offset=25)
    return page.select("organization_id", "query_id", "chunk_id", "final_rank", "total_results")


@query("r17_rag_prompt", SQL_BOTH + """, top AS (SELECT r.organization_id, r.query_id, rrf_rank, filename, c.text FROM ranked r JOIN chunk_text c USING (organization_id, chunk_id) WHERE rrf_rank <= 5)
SELECT a.organization_id, a.query_id, md5('Question: ' || any_value(a.query_text) || chr(10) || chr(10) ||
   string_agg('[Excerpt ' || rrf_rank || '] ' || filename || chr(10) || text, chr(10) || chr(10) ORDER BY rrf_rank)) AS prompt_md5,
   count(*)::INT AS source_count, string_agg(filename, ',' ORDER BY rrf_rank) AS cited FROM asked a JOIN top t USING (organization_id, query_id) GROUP BY ALL""")
def rag_prompt(spark, sf):
    chunks, asked = wh.document_chunks(spark, sf), wh.tenant_queries(spark, sf, True)
    page = hybrid.search(chunks, asked, wh.embedded_chunks(spark, sf))
    out = hybrid.prompts(page, chunks, asked)
    return out.select("organization_id", "query_id", F.md5("prompt").alias("prompt_md5"), F.size("sources").alias("source_count"),
                      F.array_join(F.transform("sources", lambda s: s["filename"]), ",").alias("cited"))


@query("r14_filter", """
SELECT doc_id, lang AS organization_id, 'repo:' || source AS repository_id FROM documents WHERE lang = 'en' AND source IN ('src1') """)
def filtered(spark, sf):
    d = wh.corpus_documents(spark, sf).withColumns({"source_type": F.lit("doc"), "module_id": F.col("repository_id"), "doc_type": F.lit("business")})
    return d.where(rt.chunk_filter("en", repository_id="repo:src1", source_type="doc", doc_type="business")).select(
        F.col("source_id").alias("doc_id"), "organization_id", "repository_id")


@query("r15_intent", """
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'SAME_MODULE_FUNCTIONS' WHEN 1 THEN 'SAME_MODULE_FUNCTIONS' WHEN 2 THEN 'SAME_FILE_FUNCTIONS'
  WHEN 3 THEN 'FILE_SYMBOLS' WHEN 4 THEN 'CONTAINING_FILE' WHEN 5 THEN 'CONTAINING_MODULE' WHEN 6 THEN 'CONTAINING_FILE' ELSE 'SEMANTIC' END AS intent,
  CASE p_partkey % 8 WHEN 7 THEN '' WHEN 3 THEN 'app/f_' || p_partkey || '.py' WHEN 5 THEN 'app/f_' || p_partkey || '.py' ELSE 'f_' || p_partkey END AS entity_name FROM part""")
def intents(spark, sf):
    p, k = wh.table(spark, sf, "part"), F.col("p_partkey")
    name, file = F.format_string("f_%d", k), F.format_string("app/f_%d.py", k)
    forms = [F.concat(F.lit("List other functions in the same module as "), name, F.lit("()")), F.concat(F.lit("siblings of function "), name),
             F.concat(F.lit("functions defined alongside "), name), F.concat(F.lit("What functions are in "), file, F.lit("?")),
             F.concat(F.lit("Where is "), name, F.lit(" defined")), F.concat(F.lit("which module contains "), file),
             F.concat(F.lit("which file defines function "), name), F.concat(F.lit("How do we settle "), "p_name")]
    text = F.element_at(F.array(*forms), (k % 8 + 1).cast("int"))
    return rt.classify_intent(p.select("p_partkey", text.alias("query_text"))).select("p_partkey", "intent", F.coalesce("entity_name", F.lit("")).alias("entity_name"))


@query("r11_metadata_whitelist", """
SELECT doc_id || '' AS doc_id, source || '_' || doc_id || '.txt' AS relative_path, '' AS heading_path, 0 AS section_level, 'unknown' AS chunk_type,
  1 AS version, length(text)::INT AS token_count FROM documents""")
def whitelist(spark, sf):
    d = wh.corpus_documents(spark, sf).select("doc_id", F.col("filename").alias("relative_path"), F.lit(None).cast("string").alias("heading_path"),
                                              F.length("text").alias("token_count"), F.lit("x").alias("secret"))
    return rt.shown_metadata(d, rt.DOC_METADATA, ["doc_id"]).select(
        "doc_id", "relative_path", "heading_path", "section_level", "chunk_type", "version", "token_count")


@query("r12_id_derivation", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'f:' || p_partkey WHEN p_partkey % 3 = 1 THEN 'repo:' || lower(p_brand) || ':file:a/' || p_partkey || '.py'
  ELSE 'file:a/' || p_partkey || '.py' END AS file_id, CASE WHEN p_partkey % 2 = 0 THEN 'd' || p_partkey WHEN p_partkey % 5 = 0 THEN '' ELSE 'doc:a/' || p_partkey || '.py' END AS doc_id FROM part""")
def derived_ids(spark, sf):
    p, k = wh.table(spark, sf, "part"), F.col("p_partkey")
    given = F.when(k % 3 == 0, F.format_string("f:%d", k)).otherwise("")
    module = F.when(k % 3 == 1, F.concat(F.lit("repo:"), F.lower("p_brand"), F.lit(":module:a"))).otherwise("a")
    path = F.format_string("a/%d.py", k)
    doc = F.when(k % 2 == 0, F.format_string("d%d", k))
    return p.select("p_partkey", rt.file_id_of(module, path, given).alias("file_id"),
                    F.coalesce(rt.doc_id_of(doc, F.when(k % 5 != 0, path)), F.lit("")).alias("doc_id"))


@query("r19_literal_search", """
WITH needle AS (SELECT item_id AS query_id, lower(trim(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2))) AS n FROM benchmark),
l AS (SELECT source || '/' || doc_id AS path, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM documents)
SELECT query_id, path, no::INT AS line, line AS text FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY path, no) AS r FROM needle JOIN l ON contains(lower(line), n)) WHERE r <= 50""")
def literal(spark, sf):
    b = wh.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("needle"))
    d = spread(wh.table(spark, sf, "documents")).select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text")
    return rt.literal_search(d, b)


@query("r20_module_snippets", SQL_CHUNKS + """, vec AS (SELECT c.organization_id, c.repository_id, c.chunk_id, e.embedding AS v FROM chunk_text c JOIN embeddings e ON e.vec_id = c.doc_id),
dim AS (SELECT organization_id, repository_id, i, avg(x::DOUBLE) AS m FROM (SELECT organization_id, repository_id, unnest(v) AS x, unnest(range(0, 64)) AS i FROM vec) GROUP BY ALL),
q AS (SELECT organization_id, repository_id, list(m ORDER BY i) AS q FROM dim GROUP BY ALL),
d AS (SELECT organization_id, repository_id, chunk_id, round(list_sum(list_transform(list_zip(q, v), lambda p: (p[1] - p[2]::DOUBLE) * (p[1] - p[2]::DOUBLE))), 6) AS distance
  FROM vec JOIN q USING (organization_id, repository_id))
SELECT *, row_number() OVER (PARTITION BY organization_id, repository_id ORDER BY distance, chunk_id)::INT AS vector_rank FROM d QUALIFY vector_rank <= 5""")
def snippets(spark, sf):
    scope = ["organization_id", "repository_id"]
    e = wh.embedded_chunks(spark, sf)
    mean = e.select(*scope, F.posexplode("embedding")).groupBy(*scope, "pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
    q = mean.groupBy(*scope).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("embedding"))
    return rt.knn(e, q.withColumn("query_id", F.lit(0)), scope, 5).drop("query_id")


@query("c17_hash_embedding", """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN_]+')) AS term FROM documents),
b AS (SELECT doc_id, ((strpos('0123456789abcdef', md5(term)[1]) - 1) * 4096 + (strpos('0123456789abcdef', md5(term)[2]) - 1) * 256
   + (strpos('0123456789abcdef', md5(term)[3]) - 1) * 16 + strpos('0123456789abcdef', md5(term)[4]) - 1) % 64 AS bucket FROM t),
c AS (SELECT doc_id, bucket, count(*) AS n FROM b GROUP BY ALL), s AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY ALL)
SELECT doc_id, bucket::INT AS bucket, round(n / norm, 4) AS weight FROM c JOIN s USING (doc_id)""")
def hashed(spark, sf):
    d = spread(wh.table(spark, sf, "documents"))
    rows = d.select("doc_id", F.posexplode(providers.hash_embedding("text")).alias("bucket", "_w"))
    return rows.where(F.col("_w") > 0).select("doc_id", "bucket", F.round(F.col("_w").cast("double"), 4).alias("weight"))


# ------------------------------------------------------------------ requirement mapping


def requirements(spark, sf, vectors=False):
    return wh.tenant_queries(spark, sf, vectors).withColumn("repository_id", F.concat(F.lit("repo:src"), (F.col("query_id") % 20).cast("string")))


SQL_MAP = SQL_KNN + """, req AS (SELECT *, 'repo:src' || (query_id % 20) AS repository_id FROM asked),
mvec AS (SELECT r.organization_id, r.repository_id, r.query_id, c.chunk_id,
    round(list_sum(list_transform(list_zip(qe.embedding, ce.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 6) AS distance
  FROM req r JOIN embeddings qe ON qe.vec_id = r.query_id JOIN chunk_text c ON c.organization_id = r.organization_id AND c.repository_id = r.repository_id
  JOIN embeddings ce ON ce.vec_id = c.doc_id),
mknn AS (SELECT *, row_number() OVER (PARTITION BY organization_id, repository_id, query_id ORDER BY distance, chunk_id) AS vector_rank FROM mvec QUALIFY vector_rank <= 20),
""" + sql_bm25("chunk_text", "req", "organization_id, repository_id", 20) + """, cand AS (
  SELECT coalesce(k.organization_id, w.organization_id) AS organization_id, coalesce(k.repository_id, w.repository_id) AS repository_id,
    coalesce(k.query_id, w.query_id) AS query_id, coalesce(k.chunk_id, w.chunk_id) AS chunk_id, vector_rank, keyword_rank
  FROM mknn k FULL OUTER JOIN kw w ON k.organization_id = w.organization_id AND k.repository_id = w.repository_id AND k.query_id = w.query_id AND k.chunk_id = w.chunk_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY organization_id, repository_id, query_id
    ORDER BY coalesce(vector_rank, 999), coalesce(keyword_rank, 999), chunk_id) AS position FROM cand QUALIFY position <= 20),
scored AS (SELECT *, (count(*) OVER (PARTITION BY organization_id, repository_id, query_id) - position + 1)::DOUBLE AS rerank_score FROM placed)
"""


def mapped(spark, sf):
    return mp.candidates(wh.document_chunks(spark, sf), requirements(spark, sf, True), wh.embedded_chunks(spark, sf))


@query("m2_order", SQL_MAP + """
SELECT organization_id, repository_id, query_id, chunk_id, position::INT AS position, coalesce(vector_rank, 999)::INT AS vector_rank, coalesce(keyword_rank, 999)::INT AS keyword_rank FROM placed""")
def map_order(spark, sf):
    return mapped(spark, sf).select("organization_id", "repository_id", "query_id", "chunk_id", "position",
                                    F.coalesce("vector_rank", F.lit(999)).alias("vector_rank"), F.coalesce("keyword_rank", F.lit(999)).alias("keyword_rank"))


@query("m3_threshold", SQL_MAP + """
SELECT organization_id, repository_id, query_id, chunk_id, rerank_score,
  CASE WHEN rerank_score > 2.0 THEN 'high' ELSE 'medium' END AS confidence FROM scored WHERE rerank_score >= 0.5 AND position <= 5""")
def map_threshold(spark, sf):
    kept = mp.survivors(mp.rerank_candidates(mapped(spark, sf))).where(F.col("rank") <= mp.JUDGED)
    return kept.select("organization_id", "repository_id", "query_id", "chunk_id", "rerank_score", mp.confidence_without_judge("rerank_score").alias("confidence"))


SQL_MODEL = """, texts AS (SELECT p.*, length(r.query_text) AS q, CASE WHEN length(c.text) <= 400 THEN length(c.text) ELSE 405 END AS n
  FROM placed p JOIN req r USING (organization_id, repository_id, query_id) JOIN chunk_text c USING (organization_id, repository_id, chunk_id)),
modelled AS (SELECT *, CASE WHEN n % 7 <> 0 THEN ((n * 31 + q * 17) % 101)::DOUBLE ELSE 1.0 - (position - 1) * 0.1 END AS rerank_score FROM texts)
"""


@query("m3_model", SQL_MAP.replace("scored AS (SELECT *, (count(*)", "unused AS (SELECT *, (count(*)") + SQL_MODEL + """
SELECT organization_id, repository_id, query_id, chunk_id, round(rerank_score, 6) AS rerank_score,
  row_number() OVER (PARTITION BY organization_id, repository_id, query_id ORDER BY rerank_score DESC, position)::INT AS rank FROM modelled WHERE rerank_score >= 0.5 QUALIFY rank <= 5""")
def map_model(spark, sf):
    """Mapping with the made-up model of :func:`mixed_lengths`; texts it cannot score fall by a tenth per place."""
    chunks = wh.document_chunks(spark, sf)
    load = lambda: lambda queries, texts: mixed_lengths(pd.Series(queries), pd.Series(texts))
    scored = mp.rerank_candidates(mapped(spark, sf), score_udf=providers.model_scores(load), requirements=requirements(spark, sf), chunks=chunks)
    kept = mp.survivors(scored).where(F.col("rank") <= mp.JUDGED)
    return kept.select("organization_id", "repository_id", "query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


@query("m4_outcomes", SQL_MAP + """, n AS (SELECT organization_id, repository_id, query_id, count(*) AS c, count(*) FILTER (rerank_score >= 8) AS k FROM scored GROUP BY ALL)
SELECT r.organization_id, r.repository_id, r.query_id, coalesce(c, 0) AS stage1_candidates, coalesce(k, 0) AS stage2_survivors, least(coalesce(k, 0), 5) AS stage3_confirmed,
  CASE WHEN coalesce(c, 0) = 0 THEN 'none' WHEN k = 0 THEN 'below' ELSE 'mapped' END AS outcome FROM req r LEFT JOIN n USING (organization_id, repository_id, query_id)""")
def map_outcomes(spark, sf):
    found = mp.rerank_candidates(mapped(spark, sf))
    kept = mp.survivors(found, threshold=8)
    out = mp.outcomes(requirements(spark, sf), found, kept, kept.where(F.col("rank") <= mp.JUDGED))
    label = F.when(F.col("unmapped_reason") == mp.REASON_NONE, "none").when(F.col("unmapped_reason") == mp.REASON_BELOW, "below").otherwise("mapped")
    return out.withColumn("outcome", label).drop("unmapped_reason")


@query("m5_judge", """
WITH o AS (SELECT o_orderkey AS request_id, o_custkey % 5 AS form, o_custkey FROM orders),
c AS (SELECT *, unnest([0, 1, 2]) AS candidate_id FROM o)
SELECT request_id, candidate_id, CASE form WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN form IN (2, 3) THEN 'reranker_only' ELSE 'llm_reasoning' END AS evidence_type, CASE WHEN candidate_id = 1 THEN 'file' ELSE 'function' END AS target_type,
  form IN (1, 2, 4) AS low_confidence
FROM c WHERE CASE form WHEN 0 THEN candidate_id = 0 WHEN 1 THEN candidate_id = 1 WHEN 4 THEN candidate_id = 2 ELSE true END""")
def judged(spark, sf):
    o = spread(wh.table(spark, sf, "orders")).select(F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % 5).alias("form"))
    top = o.select("request_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("candidate_id")).select(
        "request_id", "candidate_id", F.format_string("app/f%d_%d.py", "request_id", "candidate_id").alias("file_path"),
        F.when(F.col("candidate_id") == 1, "").otherwise("run").alias("function_name"), (F.lit(3.0) - F.col("candidate_id")).alias("rerank_score"))
    k = F.col("request_id")
    first = F.format_string('```json\n[{"candidate_id": 0, "match": true, "confidence": "HIGH", "reasoning": "f%d_0.py does it, test_x.py shows it"}, {"candidate_id": 1, "match": false, "confidence": "high", "reasoning": ""}]\n```', k)
    odd = F.lit('{"candidates": [{"candidate_id": 1, "match": true, "confidence": "high", "reasoning": "see other.py"}, {"candidate_id": 7, "match": true, "confidence": "high", "reasoning": ""}]}')
    low = F.lit('[{"candidate_id": 2, "match": true, "confidence": "low", "reasoning": "maybe"}, {"candidate_id": 0, "match": true, "confidence": "none", "reasoning": "no"}]')
    raw = F.when(F.col("form") == 0, first).when(F.col("form") == 1, odd).when(F.col("form") == 2, F.lit("I think candidate 0")).when(F.col("form") == 4, low)
    answers = o.where(F.col("form") != 3).select("request_id", raw.alias("raw_response"))
    return mp.judge(top, answers, ["request_id"]).select("request_id", "candidate_id", "confidence", "evidence_type", "target_type", "low_confidence")


@query("m10_document_mapping", SQL_CHUNKS + """, u AS (SELECT c.*, length(text) < 600 AS skipped, (doc_id + chunk_index) % 3 AS m, (doc_id % 7 = 0 AND chunk_index = 0) AS warned FROM chunk_text c)
SELECT organization_id, doc_id || '' AS doc_id, count(*) AS total_chunks, count(*) FILTER (NOT skipped AND m > 0) AS chunks_mapped,
  count(*) FILTER (skipped OR m = 0) AS chunks_unmapped, count(*) FILTER (skipped) AS chunks_skipped,
  CASE WHEN bool_or(warned) THEN 'grounding_warning' ELSE 'ok' END AS overall_generation_quality FROM u GROUP BY organization_id, doc_id""")
def document_mapping(spark, sf):
    c = mp.usable_chunks(wh.document_chunks(spark, sf).withColumn("is_stub_or_empty", F.lit(False)), 600)
    skipped = F.col("skip_reason").isNotNull()
    out = c.select("organization_id", "doc_id", skipped.alias("skipped"),
                   F.when(skipped, 0).otherwise((F.col("source_id") + F.col("chunk_index")) % 3).alias("mappings"),
                   ((F.col("source_id") % 7 == 0) & (F.col("chunk_index") == 0)).alias("warned"))
    return mp.document_summary(out, ["organization_id", "doc_id"])
