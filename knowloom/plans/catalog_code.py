"""Registered queries over source text derived from the tables: edges, chunks, facts, components.

The SQL side states the expected facts straight from the table columns, so it never sees the text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import code_chunks, graph as g, headings, relations as rl, retrieval as rt, source_facts as sfx
from ..operators.declared_facts import declared_facts
from ..session import staged
from ..sources import derived_code as dc, warehouse as wh
from .catalog_graph import SQL_GRAPH
from .registry import query

ORG = "organization_id"
SQL_SVC = """
WITH svc AS (SELECT 'org' || (o_custkey % 3) AS organization_id, 'svc' || (o_custkey % 20) || '/mod_' || o_orderkey || '.py' AS path,
  'svc' || (o_custkey % 20) || '.mod_' || o_orderkey AS module, o_orderkey AS k, o_custkey AS c, o_orderstatus, o_orderpriority FROM orders),
util AS (SELECT DISTINCT 'org' || (c_custkey % 3) AS organization_id, c_custkey % 40 AS u FROM customer)
"""


@query("e7_imports", SQL_SVC + """
SELECT svc.organization_id, path AS from_path, 'lib.util_' || (c % 50) AS module_name, 2 AS line, CASE WHEN u IS NULL THEN '' ELSE 'src/lib/util_' || u || '.py' END AS to_path, u IS NULL AS is_external
  FROM svc LEFT JOIN util ON util.organization_id = svc.organization_id AND u = c % 50
UNION ALL SELECT organization_id, path, 'os', 1, '', true FROM svc UNION ALL SELECT organization_id, path, 'json', 3, '', true FROM svc""")
def imports(spark, sf):
    return rl.python_imports(dc.service_tree(spark, sf)).select(
        ORG, "from_path", "module_name", "line", F.coalesce("to_path", F.lit("")).alias("to_path"), "is_external")


@query("e8_script_imports", """
WITH p AS (SELECT p_type AS organization_id, lower(replace(p_brand, '#', '')) AS b, p_partkey AS k FROM part)
SELECT a.organization_id, b || '/part_' || k || '.ts' AS from_path, '../' || b || '/part_' || (k + 1) AS module_name,
  CASE WHEN EXISTS (SELECT 1 FROM p q WHERE q.organization_id = a.organization_id AND q.b = a.b AND q.k = a.k + 1) THEN b || '/part_' || (k + 1) || '.ts' ELSE '' END AS to_path FROM p a
UNION ALL SELECT organization_id, b || '/part_' || k || '.ts', 'react', '' FROM p UNION ALL SELECT organization_id, b || '/part_' || k || '.ts', 'fs', '' FROM p""")
def script_imports(spark, sf):
    return rl.script_imports(dc.part_screens(spark, sf)).select(ORG, "from_path", "module_name", F.coalesce("to_path", F.lit("")).alias("to_path"))


@query("e9_calls", SQL_SVC + "SELECT organization_id, path, 'load' AS caller, 'fetch_' || k AS callee FROM svc")
def calls(spark, sf):
    return rl.calls(dc.service_tree(spark, sf)).select(ORG, "path", "caller", "callee")


@query("e10_extends", SQL_SVC + """
SELECT organization_id, path, 'Order' || k AS child, 'Base' || (c % 7) AS parent FROM svc
UNION ALL SELECT p_type, lower(replace(p_brand, '#', '')) || '/part_' || p_partkey || '.ts', 'Part' || p_partkey, 'Base' || (p_partkey % 9) FROM part""")
def extends(spark, sf):
    cols = [ORG, "repository_id", "path", "text"]
    return rl.extends(dc.service_tree(spark, sf).select(cols).unionByName(dc.part_screens(spark, sf).select(cols))).select(ORG, "path", "child", "parent")


def tested_paths(spark, sf):
    p, k = wh.table(spark, sf, "part"), F.col("p_partkey")
    made = F.array_compact(F.array(
        F.when(k % 3 == 0, F.format_string("tests/test_part_%d.py", k)), F.when(k % 3 == 1, F.format_string("ui/part_%d.test.ts", k)),
        F.when(k % 3 == 2, F.format_string("ui/__tests__/part_%d.spec.tsx", k)), F.when(k % 2 == 0, F.format_string("app/part_%d.py", k)),
        F.when(k % 4 == 0, F.format_string("web/part_%d.ts", k))))
    return p.select(F.col("p_type").alias(ORG), F.lit("repo:t").alias("repository_id"), F.explode(made).alias("path"))


@query("e11_test_edges", """
SELECT p_type AS organization_id, CASE p_partkey % 3 WHEN 0 THEN 'tests/test_part_' || p_partkey || '.py' WHEN 1 THEN 'ui/part_' || p_partkey || '.test.ts'
  ELSE 'ui/__tests__/part_' || p_partkey || '.spec.tsx' END AS test_path, 'app/part_' || p_partkey || '.py' AS source_path FROM part WHERE p_partkey % 2 = 0""")
def test_edges(spark, sf):
    return rl.test_edges(tested_paths(spark, sf)).select(ORG, "test_path", "source_path")


@query("s25_manifest_packages", """
WITH s AS (SELECT s_suppkey AS k, 'org' || (s_suppkey % 3) AS organization_id, 'team' || (s_suppkey % 25) || '/s' || s_suppkey AS d FROM supplier)
SELECT organization_id, d || '/requirements.txt' AS path, 'pkg-' || (k % 17) AS name, '>=1.' || (k % 5) AS version, 'python' AS ecosystem FROM s WHERE k % 2 = 0
UNION ALL SELECT organization_id, d || '/requirements.txt', 'requests', '*', 'python' FROM s WHERE k % 2 = 0
UNION ALL SELECT organization_id, d || '/package.json', 'lib-' || (k % 13), '^' || (k % 4) || '.0.0', 'npm' FROM s WHERE k % 2 = 1
UNION ALL SELECT organization_id, d || '/package.json', 'jest', '29', 'npm' FROM s WHERE k % 2 = 1""")
def packages(spark, sf):
    return rl.manifest_packages(dc.supplier_manifests(spark, sf)).drop("repository_id")


@query("e12_package_usage", """
WITH s AS (SELECT s_suppkey AS k, 'org' || (s_suppkey % 3) AS organization_id, 'repo:suppliers:module:team' || (s_suppkey % 25) AS module_id FROM supplier)
SELECT organization_id, 'package:python:pkg-' || (k % 17) AS package_id, module_id, count(*) AS manifests FROM s WHERE k % 2 = 0 GROUP BY ALL
UNION ALL SELECT organization_id, 'package:python:requests', module_id, count(*) FROM s WHERE k % 2 = 0 GROUP BY ALL
UNION ALL SELECT organization_id, 'package:npm:lib-' || (k % 13), module_id, count(*) FROM s WHERE k % 2 = 1 GROUP BY ALL
UNION ALL SELECT organization_id, 'package:npm:jest', module_id, count(*) FROM s WHERE k % 2 = 1 GROUP BY ALL""")
def package_usage(spark, sf):
    m = dc.supplier_manifests(spark, sf)
    used = rl.package_usage(rl.manifest_packages(m), m)[1]
    return used.groupBy(ORG, "package_id", "module_id").agg(F.count(F.lit(1)).alias("manifests"))


@query("g22_module_packages", """
WITH s AS (SELECT s_suppkey AS k, 'org' || (s_suppkey % 3) AS organization_id, 'repo:suppliers:module:team' || (s_suppkey % 25) AS module_id,
   'team' || (s_suppkey % 25) || '/s' || s_suppkey AS d FROM supplier),
r AS (SELECT organization_id, module_id, d, 'pkg-' || (k % 17) AS name, '>=1.' || (k % 5) AS version FROM s WHERE k % 2 = 0 UNION ALL SELECT organization_id, module_id, d, 'requests', '*' FROM s WHERE k % 2 = 0
  UNION ALL SELECT organization_id, module_id, d, 'lib-' || (k % 13), '^' || (k % 4) || '.0.0' FROM s WHERE k % 2 = 1 UNION ALL SELECT organization_id, module_id, d, 'jest', '29' FROM s WHERE k % 2 = 1),
v AS (SELECT organization_id, name, arg_max(version, d) AS version FROM r GROUP BY ALL)
SELECT DISTINCT organization_id, module_id, name || ' ' || v.version AS dependency FROM r JOIN v USING (organization_id, name)""")
def module_packages(spark, sf):
    m = dc.supplier_manifests(spark, sf)
    nodes, used = rl.package_usage(rl.manifest_packages(m), m)
    return g.module_packages(used, nodes)


@query("e13_co_located_docs", """
SELECT s_suppkey, 'notes/s_' || s_suppkey || '.md' AS doc_path, l_linenumber AS fn, 0.8::DOUBLE AS confidence FROM supplier JOIN (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem) ON l_suppkey = s_suppkey""")
def co_located(spark, sf):
    one = [F.lit("o").alias(ORG), F.lit("r").alias("repository_id")]
    d = wh.table(spark, sf, "supplier").select(*one, F.format_string("notes/s_%d.md", "s_suppkey").alias("path"))
    s = wh.table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber").distinct().select(
        *one, F.format_string("%d:%d", "l_suppkey", "l_linenumber").alias("symbol_id"), F.format_string("notes/S_%d.py", "l_suppkey").alias("path"))
    out = rl.co_located_documents(d, s)
    i = F.split("symbol_id", ":")
    return out.select(i[0].cast("long").alias("s_suppkey"), "doc_path", i[1].cast("int").alias("fn"), "confidence")


@query("e17_path_token_match", SQL_GRAPH + """
, t AS (SELECT organization_id, doc_id, unnest(regexp_split_to_array(lower(regexp_replace(replace(relative_path, '/', '_'), '\\.[^.]+$', '')), '[_\\-.\\s]+')) AS tok FROM docs),
k AS (SELECT * FROM t WHERE length(tok) >= 4 AND tok NOT IN ('test', 'util', 'utils', 'index', 'main', 'init', 'base', 'core', 'docs', 'readme', 'changelog', 'license', 'todo')),
m AS (SELECT k.organization_id, k.doc_id, module_id, module_name FROM k JOIN mods ON mods.organization_id = k.organization_id AND regexp_matches(lower(module_name), '\\b' || tok || '\\b'))
SELECT organization_id, doc_id, module_id FROM (SELECT *, row_number() OVER (PARTITION BY organization_id, doc_id ORDER BY length(module_name) DESC, module_name, module_id) AS r FROM m) WHERE r = 1""")
def path_tokens(spark, sf):
    return rl.link_documents_to_modules(wh.linked_documents(spark, sf), wh.modules(spark, sf))


# ------------------------------------------------------------------ chunks of source and Markdown


@query("c2_heading_chunks", """
WITH d AS (SELECT conv_id || '/' || turn AS id, conv_id, turn, role, chr(96) || chr(96) || chr(96) AS f, text FROM conversations),
b AS (SELECT *, 'Kept as it was written down by the ' || role || '.' AS intro,
   trim(text || chr(10) || chr(10) || f || chr(10) || '# not a heading' || chr(10) || f || chr(10) || chr(10) || chr(10) || '### Note' || chr(10) || 'short', ' ' || chr(10) || chr(9) || chr(13)) AS body FROM d),
r AS (SELECT *, '# Document: turn_' || conv_id || '_' || turn || '.md' || chr(10) || '# Section: Conversation ' || conv_id AS h FROM b)
SELECT 'doc:' || id || ':chunk:0' AS chunk_id, 'Conversation ' || conv_id AS heading_path, 1 AS section_level, '' AS parent_section_id, false AS has_code_fence,
  md5(h || chr(10) || '# Chunk: 1/2' || chr(10) || chr(10) || intro) AS text_md5 FROM r
UNION ALL SELECT 'doc:' || id || ':chunk:1', 'Conversation ' || conv_id || ' > Turn ' || turn, 2, 'doc:' || id || ':chunk:0', true,
  md5(h || ' > Turn ' || turn || chr(10) || '# Chunk: 2/2' || chr(10) || chr(10) || body) FROM r""")
def heading_chunks(spark, sf):
    d = dc.turn_documents(spark, sf).select(ORG, "doc_id", "filename", "text")
    return headings.heading_chunks(d).select("chunk_id", F.array_join("heading_path", " > ").alias("heading_path"), "section_level",
                                             "parent_section_id", "has_code_fence", F.md5("text").alias("text_md5"))


@query("c3_long_sections")
def long_sections(spark, sf):
    """Whole documents under one heading; tests/ checks the packing against a plain restatement."""
    d = wh.corpus_documents(spark, sf).withColumn("text", F.concat(F.lit("# All\n\n"), "text"))
    out = headings.heading_chunks(d.select(ORG, "doc_id", "filename", "text"))
    return out.select("chunk_id", "chunk_total", F.length("text").alias("chars"), "content_hash")


SQL_PAGES = """
WITH pg AS (SELECT conv_id, turn, (turn + 1) || '. Topic ' || role || chr(10) || text || chr(10) || '2.' || turn || ' Detail' || chr(10) || 'ACME running head' || chr(10)
   || 'Page ' || turn || ' of 9' || chr(10) || '3. Listed part ' || turn AS text FROM conversations),
ln AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM pg),
s AS (SELECT *, trim(raw, ' ' || chr(9)) AS line FROM ln),
noise AS (SELECT conv_id, line FROM s WHERE length(line) < 120 AND line <> '' GROUP BY ALL HAVING count(DISTINCT turn) >= 2),
k AS (SELECT s.*, CASE WHEN line = '' THEN 0 WHEN regexp_matches(line, '^\\d+\\.\\d+\\.\\d+\\s+[A-Za-z]') THEN 3 WHEN regexp_matches(line, '^\\d+\\.\\d+\\s+[A-Za-z]') THEN 2
    WHEN regexp_matches(line, '^\\d+\\.\\s+[A-Z]') OR regexp_matches(line, '(?i)^(Section|Chapter|Appendix)\\s+[\\dA-Z]+[:.]') THEN 1 ELSE 0 END AS lvl
  FROM s LEFT JOIN noise USING (conv_id, line) WHERE line = '' OR (noise.line IS NULL AND NOT regexp_matches(line, '(?i)Confidential|Page\\s+\\d+\\s+of\\s+\\d+')
    AND NOT regexp_matches(line, '^\\d+(\\.\\d+)*\\.?\\s+.+\\s+\\d{1,3}$'))),
md AS (SELECT conv_id, turn, string_agg(CASE WHEN lvl > 0 THEN repeat('#', lvl) || ' ' || line ELSE raw END, chr(10) ORDER BY n) AS md, count(*) FILTER (lvl = 1) AS tops FROM k GROUP BY ALL),
w AS (SELECT pg.conv_id, sum(coalesce(tops, 0)) AS tops, string_agg(coalesce(md, ''), chr(10) || chr(10) ORDER BY pg.turn) AS md, string_agg(text, chr(10) || chr(10) ORDER BY pg.turn) AS raw
  FROM pg LEFT JOIN md ON md.conv_id = pg.conv_id AND md.turn = pg.turn GROUP BY ALL)
SELECT conv_id, tops::INT AS top_headings, CASE WHEN tops >= 2 THEN 'heading_aware' ELSE 'fixed_window' END AS chunking_method, md5(CASE WHEN tops >= 2 THEN md ELSE raw END) AS text_md5 FROM w"""


@query("c19_page_headings", SQL_PAGES)
def page_headings(spark, sf):
    t = wh.table(spark, sf, "conversations")
    text = F.concat(F.format_string("%d. Topic %s\n", F.col("turn") + 1, F.col("role")), "text",
                    F.format_string("\n2.%d Detail\nACME running head\nPage %d of 9\n3. Listed part %d", "turn", "turn", "turn"))
    out = headings.page_headings(t.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), text.alias("text")))
    return out.select(F.col("doc_id").alias("conv_id"), "top_headings", "chunking_method", F.md5("text").alias("text_md5"))


@query("c9_syntax_chunks", SQL_SVC + """
, x AS (SELECT *, 'f' || k AS id, '# File: ' || path || chr(10) AS h FROM svc),
doc AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN '\"\"\"Order of priority ' || o_orderpriority || '.\"\"\"' ELSE 'limit = 10' END AS d FROM x)
SELECT id || '-cls-Order' || k || '-7' AS chunk_id, 'class_body' AS chunk_type, 7 AS start_line, 17 AS end_line, o_orderstatus = 'F' AS is_documented, '' AS parent_class,
  md5(h || '# Class: Order' || k || chr(10) || chr(10) || d) AS text_md5 FROM doc
UNION ALL SELECT id || '-fn-load-10', 'method', 10, 11, false, 'Order' || k, md5(h || '# Class: Order' || k || chr(10) || '# Function: load' || chr(10) || chr(10)
   || 'def load(self, key):' || chr(10) || '        return fetch_' || k || '(key)') FROM doc
UNION ALL SELECT id || '-fn-save-13', 'method', 13, 17, false, 'Order' || k, md5(h || '# Class: Order' || k || chr(10) || '# Function: save' || chr(10) || chr(10)
   || 'def save(self, value):' || chr(10) || '        if value > ' || c || ':' || chr(10) || '            raise ValueError("too big")' || chr(10) || '        self.total = value' || chr(10) || '        session.commit()') FROM doc
UNION ALL SELECT id || '-fn-fetch_' || k || '-19', 'function', 19, 21, false, '', md5(h || '# Function: fetch_' || k || chr(10) || chr(10)
   || '@router.get("/items' || (k % 100) || '/{key}")' || chr(10) || 'def fetch_' || k || '(key):' || chr(10) || '    return os.getenv("KEY_' || (c % 30) || '") or helper(key)') FROM doc""")
def syntax_chunks(spark, sf):
    f = dc.order_services(spark, sf).select(ORG, "repository_id", F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("file_id"), "path", "text")
    return code_chunks.chunk_files(f).select("chunk_id", "chunk_type", "start_line", "end_line", "is_documented", "parent_class", F.md5("text").alias("text_md5"))


@query("c10_script_chunks", """
WITH p AS (SELECT 's' || p_partkey AS id, p_partkey AS k, '# File: ' || lower(replace(p_brand, '#', '')) || '/part_' || p_partkey || '.ts' || chr(10) AS h FROM part)
SELECT id || '-cls-Part' || k || '-8' AS chunk_id, 'class_body' AS chunk_type, 8 AS start_line, 12 AS end_line, md5(h || '# Class: Part' || k || chr(10) || chr(10) || '{' || chr(10) || '}') AS text_md5 FROM p
UNION ALL SELECT id || '-fn-render-9', 'method', 9, 11, md5(h || '# Class: Part' || k || chr(10) || '# Function: render' || chr(10) || chr(10) || 'render() {' || chr(10) || '    return view' || k || '(this);' || chr(10) || '  }') FROM p
UNION ALL SELECT id || '-fn-view' || k || '-13', 'function', 13, 15, md5(h || '# Function: view' || k || chr(10) || chr(10) || 'export const view' || k || ' = (props) => {' || chr(10) || '  return process.env.API_HOST;' || chr(10) || '};') FROM p""")
def script_chunks(spark, sf):
    f = dc.part_screens(spark, sf).select(ORG, "repository_id", F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("file_id"), "path", "text")
    return code_chunks.chunk_files(f).select("chunk_id", "chunk_type", "start_line", "end_line", F.md5("text").alias("text_md5"))


@query("c14_chunk_fallback", """
SELECT 'h' || page_id AS file_id, count(*) AS chunks FROM (SELECT page_id, unnest(range(0, greatest(length(html), 1), 700)) AS s, html FROM pages)
WHERE regexp_matches(substring(html, s + 1, 800), '[^\\s]') GROUP BY page_id""")
def chunk_fallback(spark, sf):
    """Markup is neither Python nor balanced script, so every file falls back to windows."""
    p, k = wh.table(spark, sf, "pages"), F.col("page_id")
    f = p.select(F.concat(F.lit("h"), k.cast("string")).alias("file_id"), F.when(k % 2 == 0, F.format_string("p%d.py", k)).otherwise(F.format_string("p%d.html", k)).alias("path"), F.col("html").alias("text"))
    return code_chunks.chunk_files(f).groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"))


# ------------------------------------------------------------------ structural facts


def service_facts(spark, sf, kinds=None):
    return sfx.extract_facts(dc.service_tree(spark, sf), kinds)


@query("e25_symbols", SQL_SVC + """
SELECT organization_id, module || '.Order' || k AS qualified_name, 'class' AS kind, 7 AS line, 17 AS end_line FROM svc UNION ALL SELECT organization_id, module || '.Order' || k || '.load', 'method', 10, 11 FROM svc
UNION ALL SELECT organization_id, module || '.Order' || k || '.save', 'method', 13, 17 FROM svc UNION ALL SELECT organization_id, module || '.fetch_' || k, 'function', 20, 21 FROM svc
UNION ALL SELECT organization_id, 'src.lib.util_' || u || '.helper', 'function', 1, 2 FROM util""")
def python_symbols(spark, sf):
    return service_facts(spark, sf, ("symbol",)).select(ORG, F.col("owner").alias("qualified_name"), F.col("extra").alias("kind"), "line", "end_line")


@query("e25_routes_config", SQL_SVC + """
SELECT organization_id, path, 'route' AS kind, 'GET /api' || (c % 10) || '/items' || (k % 100) || '/{key}' AS shown, 20 AS line FROM svc
UNION ALL SELECT organization_id, path, 'config', 'os.getenv KEY_' || (c % 30), 21 FROM svc""")
def routes_config(spark, sf):
    f = service_facts(spark, sf, ("route", "config"))
    shown = F.when(F.col("kind") == "route", F.concat_ws(" ", "name", "value")).otherwise(F.concat_ws(" ", "owner", "name"))
    return f.select(ORG, "path", "kind", shown.alias("shown"), "line")


@query("e25_behaviours", SQL_SVC + """
SELECT organization_id, module || '.Order' || k || '.save' AS qualified_name, 13 AS start_line, 17 AS end_line, 1 AS conditions, 1 AS exceptions, 1 AS state_changes, 1 AS side_effects FROM svc""")
def behaviours(spark, sf):
    return sfx.behaviours(staged(service_facts(spark, sf, sfx.BEHAVIOUR_FACTS))).drop("repository_id", "path")


@query("e26_script_facts", """
WITH p AS (SELECT p_type AS organization_id, lower(replace(p_brand, '#', '')) || '.part_' || p_partkey AS m, p_partkey AS k FROM part)
SELECT organization_id, 'symbol' AS kind, m || '.Props' || k AS owner, 4 AS line FROM p UNION ALL SELECT organization_id, 'symbol', m || '.Part' || k, 8 FROM p UNION ALL SELECT organization_id, 'symbol', m || '.view' || k, 13 FROM p
UNION ALL SELECT organization_id, 'model', m || '.Props' || k, 4 FROM p UNION ALL SELECT organization_id, 'field', m || '.Props' || k, 4 FROM p UNION ALL SELECT organization_id, 'field', m || '.Props' || k, 4 FROM p
UNION ALL SELECT organization_id, 'config', 'process.env', 14 FROM p""")
def script_facts(spark, sf):
    return declared_facts(dc.part_screens(spark, sf), sfx.REPO + ["path"]).where(F.col("kind") != "import").select(ORG, "kind", "owner", "line")


@query("e27_java_facts", """
WITH c AS (SELECT 'org' || (c_custkey % 3) AS organization_id, 'com.acme.n' || c_nationkey || '.Customer' || c_custkey AS q, 'Customer' || c_custkey AS t, c_nationkey AS n FROM customer)
SELECT organization_id, 'symbol' AS kind, q AS owner, t AS name, 7 AS line FROM c UNION ALL SELECT organization_id, 'model', q, t, 7 FROM c
UNION ALL SELECT organization_id, 'field', q, 'name', 7 FROM c UNION ALL SELECT organization_id, 'field', q, 'balance', 7 FROM c
UNION ALL SELECT organization_id, 'symbol', q || '.find(long id)', 'find', 12 FROM c UNION ALL SELECT organization_id, 'symbol', q || '.main(String[] args)', 'main', 16 FROM c
UNION ALL SELECT organization_id, 'route', t || '.find', 'GET /n' || n || '/{id}', 11 FROM c
UNION ALL SELECT organization_id, 'config', 'Spring value', 'customer.region', 13 FROM c UNION ALL SELECT organization_id, 'entry_point', 'executable', t || '.main', 16 FROM c""")
def java_facts(spark, sf):
    f = declared_facts(dc.customer_entities(spark, sf), sfx.REPO + ["path"]).where(F.col("kind") != "import")
    return f.select(ORG, "kind", "owner", F.when(F.col("kind") == "route", F.concat_ws(" ", "name", "value")).otherwise(F.col("name")).alias("name"), "line")


@query("e28_fact_ids", SQL_SVC + """
SELECT organization_id, path, 'symbol:' || left(sha256('c0ffee:symbol:' || path || ':7:' || module || '.Order' || k), 20) AS fact_id FROM svc""")
def fact_ids(spark, sf):
    f = sfx.with_ids(service_facts(spark, sf, ("symbol",)), F.lit("c0ffee")).where(F.col("extra") == "class")
    return f.select(ORG, "path", "fact_id")


@query("e29_evidence", SQL_SVC + """
SELECT organization_id, path, 20 AS start_line, 21 AS end_line, sha256('def fetch_' || k || '(key):' || chr(10) || '    return os.getenv("KEY_' || (c % 30) || '") or helper(key)') AS content_hash FROM svc""")
def evidence(spark, sf):
    t = dc.service_tree(spark, sf)
    f = sfx.with_ids(service_facts(spark, sf, ("route",)), F.lit("c0ffee"))
    return sfx.evidence(f, t).select(ORG, "path", "start_line", "end_line", "content_hash")


@query("e30_interactions", SQL_SVC + """
SELECT svc.organization_id, 'svc' || (c % 20) AS source, 'lib' AS target, count(*) AS evidence_count FROM svc JOIN util ON util.organization_id = svc.organization_id AND u = c % 50 GROUP BY ALL""")
def interactions(spark, sf):
    t = dc.service_tree(spark, sf).withColumn("path", F.regexp_replace("path", "^src/", ""))
    return sfx.interactions(sfx.resolve_imports(staged(sfx.extract_facts(t, ("import",))), t)).drop("repository_id")


@query("e31_components", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '_root' WHEN 1 THEN 'apps/shop' WHEN 2 THEN 'backend' WHEN 3 THEN 'src/core' WHEN 4 THEN 'src' ELSE split_part(p_name, ' ', 1) END AS component FROM part""")
def component_names(spark, sf):
    p, k = wh.table(spark, sf, "part"), F.col("p_partkey")
    forms = [F.lit("a.py"), F.lit("apps/shop/x/a.py"), F.lit("backend/app/a.py"), F.lit("src/core/a.py"), F.lit("src/a.py"), F.concat(F.substring_index("p_name", " ", 1), F.lit("/b/a.py"))]
    return p.select("p_partkey", paths.component(F.element_at(F.array(*forms), (k % 6 + 1).cast("int"))).alias("component"))


@query("e32_call_targets", SQL_SVC + """
SELECT organization_id, module || '.Order' || k || '.load' AS caller, 'fetch_' || k AS target, module || '.fetch_' || k AS resolved_symbol FROM svc
UNION ALL SELECT organization_id, module || '.Order' || k || '.save', 'ValueError', '' FROM svc UNION ALL SELECT organization_id, module || '.Order' || k || '.save', 'session.commit', '' FROM svc
UNION ALL SELECT organization_id, module || '.fetch_' || k, 'os.getenv', '' FROM svc UNION ALL SELECT organization_id, module || '.fetch_' || k, 'helper', '' FROM svc""")
def call_targets(spark, sf):
    return sfx.resolve_calls(staged(service_facts(spark, sf, ("symbol", "call")))).select(ORG, "caller", "target", F.coalesce("resolved_symbol", F.lit("")).alias("resolved_symbol"))


@query("e33_component_rollup", SQL_SVC + """
SELECT organization_id, 'svc' || (c % 20) AS component, count(*) AS file_count, count(*) * 4 AS symbol_count, count(*) AS route_count, 0 AS model_count, count(*) AS python_files FROM svc GROUP BY ALL
UNION ALL SELECT organization_id, 'src/lib', count(*), count(*), 0, 0, count(*) FROM util GROUP BY ALL""")
def component_rollup(spark, sf):
    t = dc.service_tree(spark, sf)
    return sfx.components(t, sfx.extract_facts(t, sfx.COMPONENT_FACTS)).select(ORG, "component", "file_count", "symbol_count", "route_count", "model_count", F.col("languages")["Python"].alias("python_files"))


@query("e34_structural_coverage", """
WITH f AS (SELECT p_type AS organization_id, p_partkey % 4 AS m FROM part)
SELECT organization_id, count(*) FILTER (m <> 3) AS eligible_files, count(*) FILTER (m = 0) AS parsed_files, count(*) FILTER (m = 1) AS unsupported_files, count(*) FILTER (m = 2) AS failed_files,
  round(count(*) FILTER (m = 0) / count(*) FILTER (m <> 3) * 100, 1) AS coverage_percent FROM f GROUP BY ALL""")
def structural_coverage(spark, sf):
    p, k = wh.table(spark, sf, "part"), F.col("p_partkey")
    path = F.concat(F.lit("x/f"), k.cast("string"), F.element_at(F.array(*map(F.lit, (".py", ".go", ".py", ".md"))), (k % 4 + 1).cast("int")))
    t = p.select(F.col("p_type").alias(ORG), F.lit("r").alias("repository_id"), path.alias("path"), F.when(k % 4 == 2, "def broken(:").otherwise("x = 1").alias("text"))
    return sfx.structural_coverage(t, sfx.extract_facts(t)).select(ORG, "eligible_files", "parsed_files", "unsupported_files", "failed_files", "coverage_percent")


@query("g26_workflows", SQL_SVC + """
SELECT organization_id, 'GET' AS method, '/api' || (c % 10) || '/items' || (k % 100) || '/{key}' AS route_path, module || '.fetch_' || k AS qualified_name, 0 AS conditions FROM svc""")
def workflows(spark, sf):
    return sfx.workflows(staged(service_facts(spark, sf, sfx.WORKFLOW_FACTS))).select(ORG, "method", "route_path", "qualified_name", "conditions")


@query("g27_other_behaviours", SQL_SVC + "SELECT organization_id, module || '.Order' || k || '.save' AS qualified_name, 1 AS exceptions FROM svc")
def other_behaviours(spark, sf):
    return sfx.other_behaviours(staged(service_facts(spark, sf, sfx.WORKFLOW_FACTS))).select(ORG, "qualified_name", "exceptions")


@query("g28_symbol_lookup", SQL_SVC + """
SELECT 'FETCH_' || k AS symbol_name, module || '.fetch_' || k AS qualified_name FROM svc UNION ALL SELECT module || '.Order' || k, module || '.Order' || k FROM svc""")
def symbol_lookup(spark, sf):
    s = staged(service_facts(spark, sf, ("symbol",))).select(F.col("owner").alias("qualified_name"), "name", F.col("path").alias("file"), F.col("line").alias("start_line"))
    o = wh.table(spark, sf, "orders")
    module = F.format_string("svc%d.mod_%d.Order%d", F.col("o_custkey") % 20, "o_orderkey", "o_orderkey")
    asked = o.select(F.explode(F.array(F.format_string("FETCH_%d", "o_orderkey"), module)).alias("symbol_name"))
    return rt.lookup_symbols(s, asked).select("symbol_name", "qualified_name")


@query("s26_manifests", """
WITH s AS (SELECT s_suppkey AS k, 'b' || s_suppkey || '/' AS d FROM supplier)
SELECT d || 'pyproject.toml' AS path, 'runtime' AS scope, 'dep-' || (k % 11) AS name, '>=2.' || (k % 4) AS version FROM s WHERE k % 7 = 0
UNION ALL SELECT d || 'pom.xml', 'runtime', 'g' || (k % 5) || ':a' || (k % 7), '1.' || (k % 3) FROM s WHERE k % 7 = 1
UNION ALL SELECT d || 'build.gradle', 'implementation', 'org.x:y' || (k % 9) || ':1', '' FROM s WHERE k % 7 = 2
UNION ALL SELECT d || 'package.json', 'peerDependencies', 'peer-' || (k % 6), '1' FROM s WHERE k % 7 = 3""")
def manifests(spark, sf):
    m = sfx.manifest_dependencies(dc.build_files(spark, sf))
    return m.select("path", "scope", "name", F.coalesce("version", F.lit("")).alias("version"))


@query("s26_start_scripts", "SELECT 'b' || s_suppkey || '/package.json' AS path, 'start' AS target, 'node s' || s_suppkey || '.js' AS command FROM supplier WHERE s_suppkey % 7 = 3")
def start_scripts(spark, sf):
    return sfx.script_entry_points(dc.build_files(spark, sf)).select("path", "target", "command")


@query("s27_deployment", """
WITH s AS (SELECT s_suppkey AS k, 'b' || s_suppkey || '/' AS d FROM supplier)
SELECT d || 'Dockerfile' AS path, 'container_command' AS kind, 'ENTRYPOINT' AS target, '["run", "' || k || '"]' AS command, 2 AS line FROM s WHERE k % 7 = 4
UNION ALL SELECT d || 'Dockerfile', 'container_command', 'CMD', 'serve', 3 FROM s WHERE k % 7 = 4
UNION ALL SELECT d || 'docker-compose.yml', 'compose_command', 'compose_command', 'start ' || k, 3 FROM s WHERE k % 7 = 5
UNION ALL SELECT d || 'Procfile', 'process_command', 'web', 'gunicorn app' || k, 1 FROM s WHERE k % 7 = 6""")
def deployment(spark, sf):
    return sfx.deployment_entry_points(dc.build_files(spark, sf)).select("path", "kind", "target", "command", "line")


@query("repository_ingestion", SQL_SVC + """
, n AS (SELECT organization_id, count(*) AS n, count(DISTINCT c % 20) AS mods FROM svc GROUP BY ALL), u AS (SELECT organization_id, count(*) AS u FROM util GROUP BY ALL),
i AS (SELECT svc.organization_id, count(*) AS i FROM svc JOIN util ON util.organization_id = svc.organization_id AND u = c % 50 GROUP BY ALL)
SELECT organization_id, 'PART_OF' AS type, n * 5 + mods + u * 2 + 1 AS edges FROM n JOIN u USING (organization_id) UNION ALL SELECT organization_id, 'METHOD_OF', n * 2 FROM n
UNION ALL SELECT organization_id, 'OWNS', n FROM n UNION ALL SELECT organization_id, 'AUTHORED', n * 4 + u FROM n JOIN u USING (organization_id)
UNION ALL SELECT organization_id, 'IMPORTS', i FROM i UNION ALL SELECT organization_id, 'CALLS', n FROM n""")
def repository_ingestion(spark, sf):
    from .repository import build_tables

    tree = dc.service_tree(spark, sf)
    o = dc.order_services(spark, sf)
    # one commit by one author touches every service file of a tenant
    touches = o.select(ORG, "repository_id", F.lit("c1").alias("sha"), F.lit("Ann").alias("author_name"), F.lit("Ann@x.org").alias("author_email"),
                       F.lit("2024-01-01 00:00:00").cast("timestamp").alias("committed_at"), "path")
    edges = build_tables(tree, touches)["edges"]
    return edges.groupBy(ORG, "type").agg(F.count(F.lit(1)).alias("edges"))
