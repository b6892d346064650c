"""Registered queries: walks, collections, graph upkeep, versions, content dedup, run ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..operators import upkeep as up
from ..sources import warehouse as wh
from .catalog_text import SQL_TREE_PATHS, tree_paths
from .registry import query

ORG = "organization_id"


def sized_tree(spark, sf):
    """The classified tree with generated sizes; some files sit in folders a walk skips."""
    k = F.col("p_partkey")
    t = tree_paths(spark, sf)
    path = F.when(k % 13 == 0, F.concat(F.lit("node_modules/"), "path")).otherwise(F.col("path"))
    return t.select(F.col("p_type").alias(ORG), F.concat(F.lit("repo:"), "p_brand").alias("repository_id"), path.alias("path"),
                    ((k * 7919) % 2_500_000).alias("size_bytes"), (k % 11 == 0).alias("has_nul"), "p_partkey")


SQL_SIZED = "WITH RECURSIVE " + SQL_TREE_PATHS + """,
sized AS (SELECT p_type AS organization_id, 'repo:' || p_brand AS repository_id, CASE WHEN p_partkey % 13 = 0 THEN 'node_modules/' || path ELSE path END AS path,
  (p_partkey * 7919) % 2500000 AS size_bytes, p_partkey % 11 = 0 AS has_nul, p_partkey FROM tree)
"""


@query("s3_ingestion_walk", SQL_SIZED + """
, k AS (SELECT * FROM sized WHERE p_partkey % 13 <> 0 AND regexp_matches(path, '\\.(py|yaml|json|md|tsx)$') AND path NOT LIKE '%/.env')
SELECT organization_id, repository_id, path, row_number() OVER (PARTITION BY organization_id, repository_id ORDER BY path)::INT AS position,
  path LIKE 'README%' OR path LIKE 'docs/%' AS is_document FROM k""")
def ingestion_walk(spark, sf):
    return up.ingestion_walk(sized_tree(spark, sf)).select(ORG, "repository_id", "path", "position", "is_document")


@query("s4_source_inventory", SQL_SIZED + """
, r AS (SELECT *, CASE WHEN p_partkey % 13 = 0 THEN 'generated_or_vendor_directory' WHEN path LIKE '%/.env' THEN 'sensitive_file'
   WHEN has_nul THEN 'binary_or_unsupported' END AS reason FROM sized)
SELECT organization_id, repository_id, path, coalesce(reason, '') AS reason FROM r""")
def inventory(spark, sf):
    return up.source_inventory(sized_tree(spark, sf)).select(ORG, "repository_id", "path", F.coalesce("reason", F.lit("")).alias("reason"))


@query("e35_histograms", SQL_SIZED + """
, k AS (SELECT * FROM sized WHERE p_partkey % 13 <> 0 AND path NOT LIKE '%/.env' AND NOT has_nul),
l AS (SELECT organization_id, CASE WHEN path LIKE '%.py' THEN 'Python' WHEN path LIKE '%.sql' THEN 'SQL' WHEN path LIKE '%.tsx' THEN 'TypeScript' END AS label FROM k)
SELECT organization_id, label, count(*) AS files FROM l WHERE label IS NOT NULL GROUP BY ALL""")
def histograms(spark, sf):
    return up.inventory_histograms(up.source_inventory(sized_tree(spark, sf)))[0].select(ORG, F.col("language").alias("label"), "files")


@query("s10_upload_check", """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'unsafe_path' WHEN 1 THEN 'unsupported_type' ELSE CASE WHEN length(text) * 1000 > 10485760 THEN 'too_large' ELSE '' END END AS problem FROM documents""")
def upload(spark, sf):
    k = F.col("doc_id") % 5
    d = wh.table(spark, sf, "documents").select("doc_id", (F.length("text") * 1000).alias("size"),
                                                F.when(k == 0, "a\\..\\b.md").when(k == 1, "a/b.exe").when(k == 2, "a/b.PDF").otherwise("x.rst").alias("path"))
    return d.select("doc_id", F.coalesce(up.upload_problem("path", "size", max_bytes=10 * 1024 * 1024), F.lit("")).alias("problem"))


@query("s12_collection_get", "SELECT doc_id, source FROM documents WHERE lang = 'de'")
def collection_get(spark, sf):
    d = wh.table(spark, sf, "documents").withColumnRenamed("lang", ORG)
    return up.tenant(d, "de").select("doc_id", "source")


@query("s13_collection_add", """
SELECT s_suppkey AS id, 'kept' AS origin FROM supplier UNION ALL SELECT c_custkey, 'added' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def collection_add(spark, sf):
    s = wh.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("kept").alias("origin"))
    return up.append_new(s, wh.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("added").alias("origin")), ["id"])


@query("s14_collection_delete", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 0)")
def collection_delete(spark, sf):
    d = wh.table(spark, sf, "documents").join(wh.table(spark, sf, "labels"), "doc_id", "left")
    return up.delete_where(d, F.col("quality") == 0).select("doc_id", "source")


@query("s15_graph_upsert", """
WITH u AS (SELECT c_custkey AS id, TIMESTAMP '1970-01-01' AS seen, -1 AS version, c_acctbal AS balance FROM customer UNION ALL SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders)
SELECT id, version, balance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS r FROM u) WHERE r = 1""")
def graph_upsert(spark, sf):
    cur = wh.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(-1).cast("long").alias("version"), F.col("c_acctbal").alias("balance"))
    new = wh.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("balance"))
    return up.upsert_nodes(cur, new, ["id"], "version")


def supply(spark, sf):
    one = F.lit("o").alias(ORG)
    e = wh.table(spark, sf, "lineitem").select(one, F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.col("l_returnflag").alias("type"))
    s = wh.table(spark, sf, "supplier").where("s_acctbal > 0").select(one, F.concat(F.lit("s"), "s_suppkey").alias("id"))
    return s.unionByName(wh.table(spark, sf, "part").where("p_size > 10").select(one, F.concat(F.lit("p"), "p_partkey").alias("id"))), e


@query("s16_edge_upsert", """
SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target, l_returnflag AS type FROM lineitem JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0 JOIN part ON l_partkey = p_partkey AND p_size > 10""")
def edge_upsert(spark, sf):
    nodes, edges = supply(spark, sf)
    return up.upsert_edges(edges, nodes, ["source", "target", "type"]).drop(ORG)


@query("s17_detach_delete", """
SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, l_returnflag AS type FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE NOT s_acctbal > 0 AND NOT p_size > 10""")
def detach(spark, sf):
    nodes, edges = supply(spark, sf)
    return up.detach_delete(nodes, edges, nodes)[1].drop(ORG)


@query("s19_uniqueness", "SELECT lang AS organization_id, sha256(text) AS content_hash, count(*) AS rows FROM documents GROUP BY ALL HAVING count(*) > 1")
def uniqueness(spark, sf):
    d = wh.table(spark, sf, "documents").select(F.col("lang").alias(ORG), content_hash("text").alias("content_hash"))
    return up.duplicate_keys(d, [ORG, "content_hash"])


def incoming(spark, sf):
    d = wh.table(spark, sf, "documents").select("doc_id", F.col("lang").alias(ORG), content_hash("text", 32).alias("content_hash"), "text")
    k = F.col("doc_id")
    prior = d.where(k % 3 != 2).select("doc_id", F.when(k % 3 == 0, F.col("content_hash")).otherwise("old").alias("content_hash"), (k % 4).cast("int").alias("version"))
    return d, prior


@query("e6_version_assign", """
SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN 1 WHEN 0 THEN greatest(doc_id % 4, 1) ELSE doc_id % 4 + 1 END::INT AS version,
  CASE doc_id % 3 WHEN 2 THEN 'new' WHEN 0 THEN 'unchanged' ELSE 'changed' END AS state FROM documents""")
def versions(spark, sf):
    d, prior = incoming(spark, sf)
    return up.assign_versions(d, prior, ["doc_id"]).select("doc_id", "version", "state")


@query("e18_reingest", """
SELECT 'write' AS what, count(*) FILTER (doc_id % 3 <> 0) AS rows FROM documents UNION ALL SELECT 'chunks_left', count(*) FILTER (doc_id % 3 <> 1) FROM documents""")
def reingest(spark, sf):
    d, prior = incoming(spark, sf)
    write, left = up.reingest(d, prior, d.select("doc_id", "text"), ["doc_id"])
    n = lambda df, w: df.groupBy().agg(F.count(F.lit(1)).alias("rows")).select(F.lit(w).alias("what"), "rows")
    return n(write, "write").unionByName(n(left, "chunks_left"))


@query("e18_hash_dedup", """
SELECT doc_id, row_number() OVER (PARTITION BY lang, source, sha256(text) ORDER BY doc_id) > 1 AS is_copy FROM documents""")
def hash_dedup(spark, sf):
    d = wh.table(spark, sf, "documents").select("doc_id", "lang", "source", content_hash("text").alias("content_hash"))
    return up.first_copies(d, ["lang", "source"], "doc_id").select("doc_id", "is_copy")


@query("e19_ingestion_summary", """
SELECT lang AS organization_id, doc_id // 50 AS run, count(*) AS documents_total, count(*) FILTER (doc_id % 3 = 2) AS documents_new, count(*) FILTER (doc_id % 3 = 1) AS documents_changed,
  count(*) FILTER (doc_id % 3 = 0) AS documents_skipped, count(*) FILTER (length(text) < 50) AS documents_failed, count(vec_id) AS chunks_embedded,
  CASE WHEN count(*) = count(*) FILTER (length(text) < 50) THEN 'failed' WHEN count(vec_id) = 0 THEN 'completed_without_embeddings' ELSE 'completed' END AS status
FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY ALL""")
def summary(spark, sf):
    d, prior = incoming(spark, sf)
    vectors = wh.document_vectors(spark, sf).select(F.col("source_id").alias("doc_id"), F.lit(1).alias("embedded"))
    done = up.assign_versions(d, prior, ["doc_id"]).withColumns({"failed": F.length("text") < 50, "run": F.floor(F.col("doc_id") / 50)})
    return up.ingestion_summary(done.join(vectors, "doc_id", "left"), [ORG, "run"], "embedded")


@query("s11_business_documents", """
SELECT 'org' || (c_custkey % 3) AS organization_id, 'bdoc:shop/' || c_name AS source, 'repo:shop' AS target FROM customer
UNION ALL SELECT 'org' || (c_custkey % 3), 'bdoc:shop/' || c_name, 'repo:shop:module:m' || c_nationkey FROM customer WHERE c_custkey % 2 = 0""")
def business_documents(spark, sf):
    from .repository import business_document_edges

    c = wh.table(spark, sf, "customer")
    d = c.select(F.concat(F.lit("org"), F.col("c_custkey") % 3).alias(ORG), F.lit("repo:shop").alias("repository_id"), F.concat(F.lit("bdoc:shop/"), "c_name").alias("doc_id"),
                 F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("repo:shop:module:m"), "c_nationkey")).otherwise("").alias("module_id"))
    return business_document_edges(d).select(ORG, "source", "target")


def task_events(spark, sf):
    e = wh.table(spark, sf, "events")
    return e.select(F.col("user_id").alias("task_id"), F.col("ts").alias("updated_at"), "event_id", F.col("event_type").alias("status"),
                    F.get_json_object("props", "$.k").cast("int").alias("progress"))


@query("t3_latest_state", """
SELECT user_id AS task_id, ts AS updated_at, event_id, event_type AS status, (props->>'$.k')::INT AS progress FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest(spark, sf):
    return up.latest_states(task_events(spark, sf), "task_id", ["updated_at", "event_id"])


@query("t2_stale_recovery", """
WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id AS task_id, CASE WHEN event_type IN ('view', 'click') AND ts < TIMESTAMP '2024-01-30 22:00:00' - INTERVAL 30 MINUTES THEN 'failed' ELSE event_type END AS status,
  CASE WHEN event_type IN ('view', 'click') AND ts < TIMESTAMP '2024-01-30 22:00:00' - INTERVAL 30 MINUTES THEN 'interrupted' ELSE '' END AS error FROM l""")
def stale(spark, sf):
    s = up.latest_states(task_events(spark, sf), "task_id", ["updated_at", "event_id"])
    return up.recover_stale(s, ["view", "click"], F.lit("2024-01-30 22:00:00").cast("timestamp"), 30).select("task_id", "status", F.coalesce("error", F.lit("")).alias("error"))


@query("a26_run_listing", """
SELECT o_orderpriority AS organization_id, o_orderkey AS task_id, (o_custkey % 5 + 1)::INT AS documents_total,
  len(list_filter(range(1, o_custkey % 5 + 2), lambda i: (i + o_orderkey) % 2 = 0))::INT AS documents_completed,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey)::INT AS position FROM orders QUALIFY position <= 20""")
def run_listing(spark, sf):
    o = wh.table(spark, sf, "orders")
    docs = F.transform(F.sequence(F.lit(1), (F.col("o_custkey") % 5 + 1).cast("int")), lambda i: F.struct(
        F.when((i + F.col("o_orderkey")) % 2 == 0, "completed").otherwise("failed").alias("status")))
    s = o.select(F.col("o_orderpriority").alias(ORG), F.col("o_orderkey").alias("task_id"), F.col("o_orderdate").alias("updated_at"), docs.alias("documents"))
    return up.run_listing(s, 20).select(ORG, "task_id", "documents_total", "documents_completed", "position")


@query("o5_ordered_distinct", """
SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id))::INT AS position FROM events GROUP BY user_id, event_type""")
def ordered_distinct(spark, sf):
    from ..operators.retrieval import top_k

    first = wh.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("_at"))
    return top_k(first, ["user_id"], [F.asc("_at")], None, "position").drop("_at")


@query("o6_last_wins", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def last_wins(spark, sf):
    return wh.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


@query("o1_key_union", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def key_union(spark, sf):
    return wh.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).union(wh.table(spark, sf, "customer").select("c_nationkey")).distinct()


@query("o2_corpus_union", """
SELECT 'doc' AS kind, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents UNION ALL SELECT 'turn', count(*), sum(length(text))::BIGINT FROM conversations""")
def corpus_union(spark, sf):
    both = wh.table(spark, sf, "documents").select(F.lit("doc").alias("kind"), "text").unionByName(wh.table(spark, sf, "conversations").select(F.lit("turn").alias("kind"), "text"))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("o3_set_difference", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_difference(spark, sf):
    return wh.table(spark, sf, "part").select(F.col("p_partkey").alias("k")).subtract(wh.table(spark, sf, "lineitem").where("l_quantity > 45").select("l_partkey"))
