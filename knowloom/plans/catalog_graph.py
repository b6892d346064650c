"""Registered queries over the entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g, health as h, retrieval as rt
from ..session import staged
from ..sources import warehouse as wh
from .catalog_text import SQL_CHUNKS
from .registry import query

ORG = "organization_id"

SQL_GRAPH = """
WITH files AS (SELECT *, repository_id || ':module:' || module_name AS module_id, repository_id || ':file:' || path AS file_id FROM (
  SELECT p_partkey, p_type AS organization_id, 'repo:' || lower(p_brand) AS repository_id, p_size,
    CASE WHEN p_partkey % 10 = 0 THEN '' ELSE split_part(p_name, ' ', 1) || '/' END || split_part(p_name, ' ', 2) || '_' || p_partkey
      || (['.py', '.ts', '.md', '.json', '.java'])[p_size % 5 + 1] AS path,
    CASE WHEN p_partkey % 10 = 0 THEN '_root' ELSE split_part(p_name, ' ', 1) END AS module_name FROM part)),
occ AS (SELECT f.*, 'fn_' || l_linenumber || '_' || (l_suppkey % 50) AS function_name,
    CASE WHEN l_linestatus = 'O' THEN 'Cls' || l_linenumber ELSE '' END AS parent_class, (l_orderkey % 1000 + 1)::INT AS start_line,
    (l_orderkey % 1000 + 1 + l_quantity)::INT AS end_line, (l_quantity * 8)::INT AS token_count, l_returnflag = 'R' AS is_documented
  FROM lineitem JOIN files f ON l_partkey = p_partkey),
syms AS (SELECT * EXCLUDE (rn, p_size, p_partkey), file_id || '::' || function_name AS function_id FROM (SELECT *, row_number() OVER (PARTITION BY organization_id, file_id, function_name
    ORDER BY start_line, end_line, parent_class, token_count, is_documented) AS rn FROM occ) WHERE rn = 1),
cls AS (SELECT organization_id, repository_id, module_id, module_name, file_id, path, parent_class AS symbol_name, min(start_line) AS start_line, max(end_line) AS end_line
  FROM occ WHERE parent_class <> '' GROUP BY ALL),
commits AS (SELECT f.*, lower(replace(s_name, '#', '.') || '@Example.com') AS author_email, s_name AS author_name, l_shipdate AS committed_at,
    printf('%08d-%d', l_orderkey, l_linenumber) AS sha
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN files f ON l_partkey = p_partkey),
owns AS (SELECT organization_id, repository_id, module_id, file_id, author_email, max(author_name) AS author_name, count(*) AS commit_count, max(committed_at) AS last_commit_at
  FROM commits GROUP BY ALL),
docs AS (SELECT organization_id, repository_id, module_id, module_name, 'doc:' || c_name AS doc_id, filename, module_name || '/' || lower(c_name) || '/' || filename AS relative_path,
    (c_nationkey % 3 + 1)::INT AS version FROM (SELECT c.*, CASE c_mktsegment WHEN 'BUILDING' THEN 'README.md' WHEN 'MACHINERY' THEN 'package.json'
      WHEN 'AUTOMOBILE' THEN 'CONTRIBUTING.md' WHEN 'HOUSEHOLD' THEN 'guide.md' ELSE 'notes.txt' END AS filename FROM customer c) JOIN files ON c_custkey = p_partkey),
mods AS (SELECT DISTINCT organization_id, repository_id, module_id, module_name FROM files),
fowners AS (SELECT organization_id, file_id, string_agg(author_email, ',' ORDER BY author_email) AS owners FROM owns GROUP BY ALL),
asked AS (SELECT DISTINCT organization_id, n AS entity_name FROM (SELECT organization_id, repository_id, min(function_name) AS n FROM syms GROUP BY ALL))
"""


def asked_functions(spark, sf):
    return first_functions(wh.symbols(spark, sf))


def first_functions(s):
    return s.groupBy(ORG, "repository_id").agg(F.min("symbol_name").alias("entity_name")).select(ORG, "entity_name").distinct()


def owner_mails(c="owners"):
    return F.array_join(F.transform(F.col(c), lambda o: o["author_email"]), ",")


@query("g1_siblings_in_module", SQL_GRAPH + """
, t AS (SELECT a.organization_id, entity_name, module_id, min(function_id) AS lo, max(function_id) AS hi FROM asked a JOIN syms s ON a.organization_id = s.organization_id AND function_name = entity_name GROUP BY ALL)
SELECT s.organization_id, entity_name, s.function_id, s.path, s.start_line, o.owners FROM t JOIN syms s ON s.organization_id = t.organization_id AND s.module_id = t.module_id
  JOIN fowners o ON o.organization_id = s.organization_id AND o.file_id = s.file_id WHERE lo <> hi OR function_id <> lo""")
def siblings_module(spark, sf):
    out = g.siblings_in_module(asked_functions(spark, sf), wh.symbols(spark, sf), wh.ownership(spark, sf))
    return out.select(ORG, "entity_name", "function_id", "path", "start_line", owner_mails().alias("owners"))


@query("g2_siblings_in_file", SQL_GRAPH + """
, t AS (SELECT a.organization_id, entity_name, file_id, function_id FROM asked a JOIN syms s ON a.organization_id = s.organization_id AND function_name = entity_name)
SELECT s.organization_id, entity_name, s.function_id, s.start_line FROM t JOIN syms s ON s.organization_id = t.organization_id AND s.file_id = t.file_id AND s.function_id <> t.function_id""")
def siblings_file(spark, sf):
    return g.siblings_in_file(asked_functions(spark, sf), wh.symbols(spark, sf), wh.ownership(spark, sf)).select(ORG, "entity_name", "function_id", "start_line")


def asked_files(spark, sf):
    return wh.files(spark, sf).select(ORG, F.substring_index("path", "/", -1).alias("entity_name"))


@query("g3_file_symbols", SQL_GRAPH + """
SELECT f.organization_id, f.file_id, (SELECT count(*) FROM syms s WHERE s.organization_id = f.organization_id AND s.file_id = f.file_id) AS functions,
  (SELECT count(*) FROM cls c WHERE c.organization_id = f.organization_id AND c.file_id = f.file_id) AS classes,
  coalesce((SELECT string_agg(symbol_name, ',' ORDER BY symbol_name) FROM cls c WHERE c.organization_id = f.organization_id AND c.file_id = f.file_id), '') AS class_names,
  coalesce(o.owners, '') AS owners FROM files f LEFT JOIN fowners o ON o.organization_id = f.organization_id AND o.file_id = f.file_id""")
def file_symbols(spark, sf):
    out = g.file_symbols(asked_files(spark, sf), wh.files(spark, sf), wh.symbols(spark, sf), wh.classes(spark, sf), wh.ownership(spark, sf))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return out.groupBy(ORG, "file_id").agg(F.first("functions").alias("f"), F.first("classes").alias("c"), F.first("owners").alias("o")).select(
        ORG, "file_id", F.greatest(size("f"), F.lit(0)).alias("functions"), F.greatest(size("c"), F.lit(0)).alias("classes"),
        F.coalesce(F.array_join(F.array_sort(F.transform("c", lambda x: x["symbol_name"])), ","), F.lit("")).alias("class_names"),
        F.coalesce(owner_mails("o"), F.lit("")).alias("owners"))


@query("g4_containing_file", SQL_GRAPH + """
SELECT s.organization_id, 'Function' AS symbol_type, function_name AS symbol_name, s.file_id, s.module_id, s.start_line FROM syms s JOIN asked a ON a.organization_id = s.organization_id AND entity_name = function_name
UNION ALL SELECT organization_id, 'Class', symbol_name, file_id, module_id, start_line FROM cls""")
def containing_file(spark, sf):
    c = wh.classes(spark, sf)
    asked = asked_functions(spark, sf).unionByName(c.select(ORG, F.col("symbol_name").alias("entity_name")).distinct())
    return g.containing_file(asked, wh.symbols(spark, sf), c, wh.ownership(spark, sf)).select(
        ORG, "symbol_type", "symbol_name", "file_id", "module_id", "start_line")


@query("g5_containing_module", SQL_GRAPH + """
SELECT f.organization_id, split_part(f.path, '/', -1) AS entity_name, f.file_id, f.module_id, f.repository_id, coalesce(o.owners, '') AS owners
FROM files f LEFT JOIN fowners o ON o.organization_id = f.organization_id AND o.file_id = f.file_id""")
def containing_module(spark, sf):
    out = g.containing_module(asked_files(spark, sf), wh.files(spark, sf), wh.ownership(spark, sf))
    return out.select(ORG, "entity_name", "file_id", "module_id", "repository_id", F.coalesce(owner_mails(), F.lit("")).alias("owners"))


@query("g6_structural_dispatch", SQL_GRAPH + """
, q AS (SELECT organization_id, 'CONTAINING_FILE' AS intent, entity_name FROM asked UNION ALL SELECT organization_id, 'CONTAINING_MODULE', split_part(path, '/', -1) FROM files WHERE path LIKE '%.py')
SELECT q.organization_id, q.intent, q.entity_name, s.file_id AS chunk_id,
  '# Symbol: ' || s.function_name || ' (Function)' || chr(10) || '# File: ' || s.path || chr(10) || '# Module: ' || s.module_name AS text, len(string_split(o.owners, ','))::INT AS owner_count
  FROM q JOIN syms s ON s.organization_id = q.organization_id AND s.function_name = q.entity_name AND intent = 'CONTAINING_FILE' JOIN fowners o ON o.organization_id = s.organization_id AND o.file_id = s.file_id
UNION ALL SELECT q.organization_id, q.intent, q.entity_name, f.file_id, '# Symbol: ' || f.path || ' (File)' || chr(10) || '# File: ' || f.path || chr(10) || '# Module: ' || f.module_name,
  coalesce(len(string_split(o.owners, ',')), 0)::INT FROM q JOIN files f ON f.organization_id = q.organization_id AND split_part(f.path, '/', -1) = q.entity_name AND intent = 'CONTAINING_MODULE'
  LEFT JOIN fowners o ON o.organization_id = f.organization_id AND o.file_id = f.file_id""")
def dispatch(spark, sf):
    # Five traversals read these: each is made once, and no side is broadcast by the size of its packed columns.
    f, functions, classes, owns = (staged(df).hint("merge") for df in (wh.files(spark, sf), wh.symbols(spark, sf), wh.classes(spark, sf), wh.ownership(spark, sf)))
    asked = first_functions(functions).select(ORG, F.format_string("where is function %s defined", "entity_name").alias("query_text"))
    asked = asked.unionByName(f.where(F.col("path").endswith(".py")).select(ORG, F.format_string("which module contains %s", F.substring_index("path", "/", -1)).alias("query_text")))
    out = g.structural_answers(rt.classify_intent(asked), f, functions, classes, owns)
    return out.select(ORG, "intent", "entity_name", "chunk_id", "text", "owner_count")


@query("g7_code_expansion", SQL_GRAPH + """
, rel AS (SELECT organization_id, module_id, doc_id AS id FROM docs UNION SELECT organization_id, module_id, file_id FROM files WHERE path LIKE '%.md' OR path LIKE '%.txt'),
own AS (SELECT f.organization_id, f.file_id, r.id FROM files f JOIN rel r ON r.organization_id = f.organization_id AND (r.module_id = f.module_id OR r.module_id = f.repository_id || ':module:_root') WHERE r.id <> f.file_id),
n AS (SELECT organization_id, file_id, count(DISTINCT id) AS n, min(id) AS first_id FROM own GROUP BY ALL)
SELECT f.organization_id, f.file_id, f.module_id, coalesce(n, 0)::INT AS related, coalesce(first_id, '') AS first_related, coalesce(o.owners, '') AS owners
FROM files f LEFT JOIN n ON n.organization_id = f.organization_id AND n.file_id = f.file_id LEFT JOIN fowners o ON o.organization_id = f.organization_id AND o.file_id = f.file_id""")
def code_expansion(spark, sf):
    f = wh.files(spark, sf)
    out = g.expand_code(f, f, wh.ownership(spark, sf), wh.linked_documents(spark, sf))
    return out.select(ORG, "file_id", "module_id", F.col("related_count").cast("int").alias("related"), F.coalesce("first_related", F.lit("")).alias("first_related"),
                      F.coalesce(owner_mails(), F.lit("")).alias("owners"))


@query("r10_page_expansion", SQL_GRAPH + """
, page AS (SELECT organization_id, min(file_id) AS file_id FROM files GROUP BY ALL), f AS (SELECT files.* FROM files JOIN page USING (organization_id, file_id)),
rel AS (SELECT organization_id, module_id, doc_id AS id FROM docs UNION SELECT organization_id, module_id, file_id FROM files WHERE path LIKE '%.md' OR path LIKE '%.txt')
SELECT DISTINCT f.organization_id, f.file_id, r.id FROM f JOIN rel r ON r.organization_id = f.organization_id AND (r.module_id = f.module_id OR r.module_id = f.repository_id || ':module:_root') WHERE r.id <> f.file_id""")
def page_expansion(spark, sf):
    """The first file of every tenant stands for a result page."""
    f = wh.files(spark, sf)
    return g.related_documents(f.groupBy(ORG).agg(F.min("file_id").alias("file_id")), f, wh.linked_documents(spark, sf)).select(ORG, "file_id", "id")


@query("g8_doc_expansion", SQL_GRAPH + """
SELECT d.organization_id, d.doc_id, d.module_id, count(f.file_id) AS related_code_files, min(f.path) AS first_code_file
FROM docs d LEFT JOIN files f ON f.organization_id = d.organization_id AND f.repository_id = d.repository_id GROUP BY ALL""")
def doc_expansion(spark, sf):
    d = wh.linked_documents(spark, sf)
    return g.expand_documents(d, d, wh.files(spark, sf)).drop("repository_id")


@query("g9_topology_modules", SQL_GRAPH + """
SELECT organization_id, repository_id, module_id FROM (SELECT DISTINCT organization_id, repository_id FROM files) r JOIN mods USING (organization_id, repository_id)
QUALIFY row_number() OVER (PARTITION BY organization_id ORDER BY repository_id, module_id) <= 250""")
def topology_modules(spark, sf):
    m = wh.modules(spark, sf)
    return g.topology_modules(m.select(ORG, "repository_id").distinct(), m, 250).select(ORG, "repository_id", "module_id")


@query("g10_topology_files", SQL_GRAPH + """
SELECT f.organization_id, f.file_id, (SELECT count(DISTINCT author_email) FROM owns o WHERE o.organization_id = f.organization_id AND o.file_id = f.file_id) AS owner_count,
  (SELECT count(DISTINCT doc_id) FROM docs d WHERE d.organization_id = f.organization_id AND d.module_id = f.module_id) AS document_count
FROM (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY organization_id ORDER BY file_id) <= 250) f""")
def topology_files(spark, sf):
    return g.topology_files(wh.files(spark, sf), wh.ownership(spark, sf), wh.linked_documents(spark, sf), 250).select(ORG, "file_id", "owner_count", "document_count")


@query("g11_import_subgraph", SQL_GRAPH + """
, py AS (SELECT organization_id, file_id FROM files WHERE p_size % 5 < 2)
SELECT a.organization_id, a.file_id AS source, b.file_id AS target FROM files a JOIN files b ON b.p_partkey = a.p_partkey + 1 AND a.organization_id = b.organization_id
WHERE (a.organization_id, a.file_id) IN (SELECT organization_id, file_id FROM py) AND (b.organization_id, b.file_id) IN (SELECT organization_id, file_id FROM py)""")
def import_subgraph(spark, sf):
    nodes = wh.files(spark, sf).where(F.col("path").rlike(r"\.(py|ts)$")).select(ORG, F.col("file_id").alias("id"))
    return g.links_within(wh.import_links(spark, sf), nodes).select(ORG, "source", "target")


@query("g12_functions_and_callees", SQL_GRAPH + """
, c AS (SELECT s.organization_id, s.function_id, t.function_name AS callee FROM syms s JOIN syms t ON t.organization_id = s.organization_id AND t.file_id = s.file_id
   AND t.function_name = 'fn_' || (split_part(s.function_name, '_', 2)::INT + 1) || '_' || split_part(s.function_name, '_', 3))
SELECT s.organization_id, s.function_id, coalesce(c.callee, '') AS callee FROM syms s LEFT JOIN c ON c.organization_id = s.organization_id AND c.function_id = s.function_id""")
def callees(spark, sf):
    s = wh.symbols(spark, sf).select(ORG, "function_id")
    c = wh.call_edges(spark, sf).select(ORG, F.col("source").alias("function_id"), "callee")
    return s.join(c, [ORG, "function_id"], "left").select(ORG, "function_id", F.coalesce("callee", F.lit("")).alias("callee"))


SQL_TRADE = """
WITH trade AS (SELECT 'org' || n_regionkey AS organization_id, s_nationkey::VARCHAR AS source, c_nationkey::VARCHAR AS target, count(*) AS evidence_count
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL),
nodes AS (SELECT DISTINCT 'org' || b.n_regionkey AS organization_id, a.n_nationkey::VARCHAR AS id, 'N' || a.n_regionkey AS label FROM nation a, nation b)
"""


def nation_nodes(spark, sf):
    """Every nation as a node of each of the five regions' tenants."""
    n = wh.table(spark, sf, "nation")
    return n.select(F.col("n_nationkey").cast("string").alias("id"), F.concat(F.lit("N"), "n_regionkey").alias("label"),
                    F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda r: F.concat(F.lit("org"), r.cast("string")))).alias(ORG))


@query("g13_link_dedup", SQL_TRADE + """
SELECT organization_id, source, target FROM trade WHERE source <> target AND source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)""")
def link_dedup(spark, sf):
    return g.clean_links(wh.trade_links(spark, sf), nation_nodes(spark, sf)).select(ORG, "source", "target")


@query("u1_induced_subgraph", SQL_TRADE + """
SELECT t.organization_id, source, target, evidence_count FROM trade t JOIN nodes a ON a.organization_id = t.organization_id AND a.id = source AND a.label IN ('N0', 'N1')
JOIN nodes b ON b.organization_id = t.organization_id AND b.id = target AND b.label IN ('N0', 'N1')""")
def induced(spark, sf):
    return g.induced_subgraph(nation_nodes(spark, sf), wh.trade_links(spark, sf), ["N0", "N1"])[1].select(ORG, "source", "target", "evidence_count")


@query("u2_adjacency", SQL_TRADE + """
SELECT DISTINCT organization_id, source, target FROM (SELECT organization_id, source, target FROM trade UNION ALL SELECT organization_id, target, source FROM trade) WHERE source <> target""")
def adjacency(spark, sf):
    return g.adjacency(wh.trade_links(spark, sf))


@query("u3_label_counts", SQL_GRAPH + """
SELECT organization_id, 'Module' AS label, count(*) AS nodes FROM mods GROUP BY ALL UNION ALL SELECT organization_id, 'File', count(*) FROM files GROUP BY ALL
UNION ALL SELECT organization_id, 'Function', count(*) FROM syms GROUP BY ALL UNION ALL SELECT organization_id, 'Class', count(*) FROM cls GROUP BY ALL
UNION ALL SELECT organization_id, 'Document', count(*) FROM docs GROUP BY ALL""")
def label_counts(spark, sf):
    return all_nodes(spark, sf).groupBy(ORG, "label").agg(F.count(F.lit(1)).alias("nodes"))


def all_nodes(spark, sf):
    none = F.lit(None).cast("string")
    num = F.lit(None).cast("double")

    def shape(df, label, id_, name, path, loc=num, cx=num):
        return df.select(ORG, F.lit(label).alias("label"), F.col(id_).alias("id"), F.col(name).alias("name"),
                         (F.col(path) if path else none).alias("path"), loc.alias("loc"), cx.alias("complexity"))

    return (
        shape(wh.modules(spark, sf), "Module", "module_id", "module_name", "module_path")
        .unionByName(shape(wh.files(spark, sf), "File", "file_id", "path", "path", F.col("loc").cast("double")))
        .unionByName(shape(wh.symbols(spark, sf), "Function", "symbol_id", "symbol_name", None, num, F.col("token_count").cast("double")))
        .unionByName(shape(wh.classes(spark, sf), "Class", "symbol_id", "symbol_name", None))
        .unionByName(shape(wh.linked_documents(spark, sf), "Document", "doc_id", "filename", "relative_path"))
    )


@query("g14_node_format", SQL_GRAPH + """
SELECT organization_id, module_id AS id, 'Module' AS label, module_name AS display_name, '#5579e8' AS color, 'Module' AS badge, 18.0 AS val FROM mods
UNION ALL SELECT organization_id, file_id, 'File', split_part(path, '/', -1), '#44833f', 'File', round(least(30.0, greatest(8.0, 12.0 + p_size * 20 / 150.0)), 1) FROM files
UNION ALL SELECT organization_id, function_id, 'Function', function_name, '#ed7c4a', 'Function', round(least(25.0, greatest(8.0, 8.0 + token_count / 4.0)), 1) FROM syms
UNION ALL SELECT organization_id, file_id || '::' || symbol_name, 'Class', symbol_name, '#8d6aca', 'Class', 10.0 FROM cls
UNION ALL SELECT organization_id, doc_id, 'Document', filename, '#0d9488', 'Doc', 14.0 FROM docs""")
def node_format(spark, sf):
    return g.format_nodes(all_nodes(spark, sf)).select(ORG, "id", "label", "display_name", "color", "badge", "val")


@query("g15_neighbours", SQL_GRAPH + """
, e AS (SELECT a.organization_id, a.file_id AS source, b.file_id AS target FROM files a JOIN files b ON b.p_partkey = a.p_partkey + 1 AND a.organization_id = b.organization_id)
SELECT organization_id, source AS centre, target AS neighbour, 'out' AS direction FROM e UNION ALL SELECT organization_id, target, source, 'in' FROM e""")
def neighbours(spark, sf):
    c = wh.files(spark, sf).select(ORG, F.col("file_id").alias("id"))
    return g.neighbours(c, wh.import_links(spark, sf)).select(ORG, "centre", "neighbour", "direction")


@query("g16_node_search", SQL_GRAPH + """
SELECT organization_id, id, name FROM (SELECT organization_id, module_id AS id, module_name AS name, module_name AS path FROM mods UNION ALL SELECT organization_id, file_id, path, path FROM files
  UNION ALL SELECT organization_id, function_id, function_name, NULL FROM syms UNION ALL SELECT organization_id, file_id || '::' || symbol_name, symbol_name, NULL FROM cls UNION ALL SELECT organization_id, doc_id, filename, relative_path FROM docs)
WHERE contains(lower(name), 'widget') OR contains(lower(coalesce(path, '')), 'widget') QUALIFY row_number() OVER (PARTITION BY organization_id ORDER BY name, id) <= 50""")
def node_search(spark, sf):
    asked = wh.files(spark, sf).select(ORG).distinct().withColumn("query_text", F.lit(" Widget "))
    return g.search_nodes(all_nodes(spark, sf), asked).select(ORG, "id", "name")


@query("g17_repo_listing", SQL_GRAPH + """
SELECT organization_id, repository_id, count(DISTINCT module_id) AS module_count, count(DISTINCT file_id) AS file_count,
  (SELECT count(DISTINCT doc_id) FROM docs d WHERE d.organization_id = f.organization_id AND d.repository_id = f.repository_id) AS document_count FROM files f GROUP BY organization_id, repository_id""")
def repo_listing(spark, sf):
    m = wh.modules(spark, sf)
    return g.repository_listing(m.select(ORG, "repository_id").distinct(), m, wh.files(spark, sf), wh.linked_documents(spark, sf))


@query("g18_module_topology", SQL_GRAPH + """
SELECT m.organization_id, m.module_id, (SELECT count(*) FROM files f WHERE f.organization_id = m.organization_id AND f.module_id = m.module_id) AS file_count,
 (SELECT count(*) FROM syms f WHERE f.organization_id = m.organization_id AND f.module_id = m.module_id) AS function_count,
 (SELECT count(*) FROM cls f WHERE f.organization_id = m.organization_id AND f.module_id = m.module_id) AS class_count FROM mods m""")
def module_topology(spark, sf):
    return g.module_topology(wh.modules(spark, sf), wh.files(spark, sf), wh.symbols(spark, sf), wh.classes(spark, sf)).select(
        ORG, "module_id", "file_count", "function_count", "class_count")


@query("g19_module_fallback", SQL_GRAPH + """
SELECT organization_id, regexp_replace(module_id, '^repo:', '') AS asked_id, module_id, 'module' AS matched_as FROM mods UNION ALL SELECT organization_id, file_id, module_id, 'file' FROM files""")
def module_fallback(spark, sf):
    m, f = wh.modules(spark, sf), wh.files(spark, sf)
    ids = m.select(ORG, F.regexp_replace("module_id", "^repo:", "").alias("asked_id")).unionByName(f.select(ORG, F.col("file_id").alias("asked_id")))
    return g.resolve_modules(ids, m, f)


@query("g20_module_owners", SQL_GRAPH + """
, r AS (SELECT organization_id, module_id, author_email, sum(commit_count)::BIGINT AS total_commits, max(last_commit_at) AS last_active FROM owns GROUP BY ALL)
SELECT organization_id, module_id, author_email, total_commits, last_active, count(*) OVER (PARTITION BY organization_id, module_id) AS owner_count,
  row_number() OVER (PARTITION BY organization_id, module_id ORDER BY total_commits DESC, author_email)::INT AS owner_rank FROM r QUALIFY owner_rank <= 10""")
def module_owners(spark, sf):
    return h.module_owners(wh.ownership(spark, sf)).drop("author_name")


@query("g21_linked_documents", SQL_GRAPH + """
SELECT organization_id, module_id, doc_id, filename, version, coalesce(left(text, 300), '') AS lead_excerpt FROM docs LEFT JOIN documents t ON doc_id = printf('doc:Customer#%09d', t.doc_id) """.replace(
    "ON doc_id = printf('doc:Customer#%09d', t.doc_id)", "ON docs.doc_id = printf('doc:Customer#%09d', t.doc_id)").replace("module_id, doc_id, filename", "module_id, docs.doc_id, filename"))
def linked_documents(spark, sf):
    d = wh.linked_documents(spark, sf)
    t = wh.table(spark, sf, "documents").select(F.format_string("doc:Customer#%09d", "doc_id").alias("doc_id"), "text")
    chunks = d.select(ORG, "doc_id").join(t, "doc_id").withColumn("chunk_index", F.lit(0))
    return g.linked_documents_with_excerpt(d, chunks)


@query("g23_manifest_documents", SQL_GRAPH + """
, m AS (SELECT organization_id, repository_id, count(DISTINCT relative_path) AS n FROM docs WHERE filename = 'package.json' GROUP BY ALL)
SELECT o.organization_id, o.module_id, CASE WHEN n > 0 THEN 'found' ELSE 'not_found' END AS status, coalesce(n, 0) AS manifest_count FROM mods o LEFT JOIN m USING (organization_id, repository_id)""")
def manifest_documents(spark, sf):
    return g.repository_manifests(wh.modules(spark, sf), wh.linked_documents(spark, sf)).select(ORG, "module_id", "status", F.coalesce("manifest_count", F.lit(0)).alias("manifest_count"))


@query("g24_callers", SQL_GRAPH + """
, c AS (SELECT DISTINCT s.organization_id, s.path, t.function_name AS callee, s.function_name AS caller FROM syms s JOIN syms t ON t.organization_id = s.organization_id AND t.file_id = s.file_id
   AND t.function_name = 'fn_' || (split_part(s.function_name, '_', 2)::INT + 1) || '_' || split_part(s.function_name, '_', 3))
SELECT organization_id, path, callee, caller, row_number() OVER (PARTITION BY organization_id, path, callee ORDER BY caller)::INT AS position FROM c QUALIFY position <= 5""")
def callers(spark, sf):
    c = wh.call_edges(spark, sf)
    return g.callers(c, c)


@query("g25_business_chunk_resolve", SQL_CHUNKS + """, a AS (SELECT lang, doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id || ':chunk:0' WHEN 1 THEN doc_id || ':chunk:9999' ELSE doc_id || '' END AS asked_id FROM documents)
SELECT doc_id || '' AS doc_id, asked_id, chunk_id FROM (SELECT c.doc_id, asked_id, chunk_id, row_number() OVER (PARTITION BY c.doc_id
  ORDER BY CASE WHEN chunk_id = asked_id THEN 0 WHEN suffix(chunk_id, asked_id) THEN 1 ELSE 2 END, chunk_index) AS r FROM a JOIN chunk_text c USING (doc_id)) WHERE r = 1""")
def business_chunk(spark, sf):
    d = wh.corpus_documents(spark, sf)
    k = F.col("source_id") % 3
    asked = d.select(ORG, F.when(k == 0, F.concat("doc_id", F.lit(":chunk:0"))).when(k == 1, F.concat("doc_id", F.lit(":chunk:9999"))).otherwise(F.col("doc_id")).alias("asked_id"))
    return g.resolve_business_chunk(asked, wh.document_chunks(spark, sf)).select("doc_id", "asked_id", "chunk_id")


@query("u4_merge_expansion", """
SELECT s_suppkey AS id, 'shown' AS origin FROM supplier UNION ALL SELECT DISTINCT l_partkey, 'added' FROM lineitem WHERE l_partkey NOT IN (SELECT s_suppkey FROM supplier)""")
def merge_expansion(spark, sf):
    shown = wh.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("shown").alias("origin"))
    added = wh.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.lit("added").alias("origin"))
    return g.merge_expansion(shown, added, ["id"])
