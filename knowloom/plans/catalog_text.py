"""Registered queries over text: chunking, headers, tokens, hashes, redaction, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, text as tx
from ..operators import chunking
from ..session import spread
from ..sources import warehouse as wh
from .registry import query

# The window rule restated for the check: one row per document and kept start.
SQL_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"
SQL_CHUNKS = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, lang, source, text, length(text) AS len FROM documents),
starts AS (
  SELECT doc_id, 0 AS s FROM docs WHERE len > 0
  UNION ALL
  SELECT st.doc_id, st.s + 1700 FROM starts st JOIN docs d USING (doc_id) WHERE st.s + 2000 < d.len),
zoned AS (
  SELECT d.*, s, substring(text, s + 851, 1150) AS zone, s + 2000 < len AS inner_window FROM starts JOIN docs d USING (doc_id)),
ended AS (
  SELECT doc_id, lang, source, text, s AS start_char,
    CASE WHEN NOT inner_window THEN len
         WHEN contains(zone, chr(10) || chr(10)) THEN greatest(s + 1700, s + 850 + length(regexp_extract(zone, '(?s)^.*\\n\\n')))
         WHEN contains(zone, chr(10)) THEN greatest(s + 1700, s + 850 + length(regexp_extract(zone, '(?s)^.*\\n')))
         ELSE s + 2000 END AS end_char FROM zoned),
bodies AS (
  SELECT doc_id, lang, source, start_char, end_char,
    trim(substring(text, start_char + 1, end_char - start_char), {SQL_SPACE}) AS body FROM ended),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_char) - 1 AS chunk_index,
    count(*) OVER (PARTITION BY doc_id) AS chunk_total FROM bodies WHERE body <> ''),
chunks AS (
  SELECT lang AS organization_id, 'repo:' || source AS repository_id, doc_id, doc_id || ':chunk:' || chunk_index AS chunk_id,
    chunk_index, chunk_total, start_char, end_char,
    '# Document: ' || source || '_' || doc_id || '.txt' || chr(10) || '# Section: root' || chr(10)
      || '# Chunk: ' || (chunk_index + 1) || '/' || chunk_total || chr(10) AS header, body,
    source || '_' || doc_id || '.txt' AS filename FROM numbered),
chunk_text AS (SELECT *, header || chr(10) || body AS text FROM chunks)
"""


@query("c1_fixed_window_chunks", SQL_CHUNKS + """
SELECT organization_id, repository_id, chunk_id, chunk_index::INT AS chunk_index, chunk_total::INT AS chunk_total,
       start_char::INT AS start_char, end_char::INT AS end_char, sha256(text) AS content_hash FROM chunk_text""")
def fixed_window(spark, sf):
    return wh.document_chunks(spark, sf).select(
        "organization_id", "repository_id", "chunk_id", "chunk_index", "chunk_total", "start_char", "end_char", "content_hash")


@query("c4_chunk_header", SQL_CHUNKS + "SELECT chunk_id, header FROM chunks")
def headers(spark, sf):
    c = wh.document_chunks(spark, sf)
    return c.select("chunk_id", chunking.document_header("filename", F.lit("root"), "chunk_index", "chunk_total").alias("header"))


@query("c5_token_approx", """
SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::INT AS approx_tokens FROM documents""")
def token_approx(spark, sf):
    return wh.table(spark, sf, "documents").select("doc_id", tx.approx_tokens("text").alias("approx_tokens"))


@query("c6_code_fence", """
SELECT 'documents' AS source, doc_id AS id, contains(text, '```') OR contains(text, '~~~') AS has_code_fence FROM documents
UNION ALL SELECT 'pages', page_id, contains(html, '```') OR contains(html, '~~~') FROM pages
UNION ALL SELECT 'labels', p_partkey, (p_partkey % 3 = 0) FROM part""")
def code_fence(spark, sf):
    rows = wh.table(spark, sf, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text")
    rows = rows.unionByName(wh.table(spark, sf, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("text")))
    p = wh.table(spark, sf, "part")
    fenced = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("see\n~~~\n"), "p_name", F.lit("\n~~~"))).otherwise(F.col("p_name"))
    rows = rows.unionByName(p.select(F.lit("labels").alias("source"), F.col("p_partkey").alias("id"), fenced.alias("text")))
    return rows.select("source", "id", tx.has_code_fence("text").alias("has_code_fence"))


@query("c7_chunk_dispatch", SQL_CHUNKS + """, routed AS (
  SELECT d.doc_id, d.source, length(d.text) AS len, (SELECT count(*) FROM chunks c WHERE c.doc_id = d.doc_id) AS n FROM documents d)
SELECT doc_id, CASE WHEN n = 0 THEN 'empty' WHEN doc_id % 2 = 0 THEN 'fixed_window' ELSE 'fixed_window_fallback' END AS route,
       n::INT AS chunks FROM routed""")
def dispatch(spark, sf):
    from ..operators.headings import chunk_documents
    d = wh.corpus_documents(spark, sf).withColumn("chunking_method", F.when(F.col("source_id") % 2 == 0, "fixed_window").otherwise("heading_aware"))
    n = chunk_documents(d).groupBy("source_id").agg(F.count(F.lit(1)).cast("int").alias("chunks"), F.min("route").alias("route"))
    return d.select("source_id").join(n, "source_id", "left").select(
        F.col("source_id").alias("doc_id"), F.coalesce("route", F.lit("empty")).alias("route"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("c11_code_windows", """
WITH s AS (SELECT page_id, url, html, length(html) AS len, unnest(range(0, greatest(length(html), 1), 700)) AS s FROM pages),
b AS (SELECT *, substring(html, s + 1, 800) AS body, least(s + 800, len) AS e FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY s) AS i, count(*) OVER (PARTITION BY page_id) AS n
      FROM b WHERE regexp_matches(body, '[^\\s]'))
SELECT page_id || '-chunk-' || i AS chunk_id, i::INT AS chunk_number, n::INT AS chunk_total,
  (len(string_split(left(html, s), chr(10))))::INT AS start_line, (len(string_split(left(html, e), chr(10))))::INT AS end_line,
  md5('# File: ' || url || chr(10) || '# Chunk: ' || i || '/' || n || chr(10) || chr(10) || body) AS text_md5 FROM k""")
def code_windows(spark, sf):
    f = spread(wh.table(spark, sf, "pages")).select(F.col("page_id").cast("string").alias("file_id"), F.col("url").alias("path"), F.col("html").alias("text"))
    return chunking.code_window_chunks(f).select("chunk_id", "chunk_number", "chunk_total", "start_line", "end_line", F.md5("text").alias("text_md5"))


@query("c12_giant_split", """
WITH h AS (SELECT doc_id, text, '# File: ' || source || chr(10) AS header FROM documents WHERE length(text) > 0),
g AS (SELECT *, greatest(3000 - length(header) - 50, 500) AS size, length(header) + 1 + length(text) > 3000 AS giant FROM h),
p AS (SELECT doc_id, header, giant, size, text, unnest(CASE WHEN giant THEN range(0, length(text), size - 100) ELSE [0] END) AS s FROM g),
q AS (SELECT *, CASE WHEN giant THEN substring(text, s + 1, size) ELSE text END AS part FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS i FROM q WHERE NOT giant OR regexp_matches(part, '[^\\s]'))
SELECT CASE WHEN giant THEN doc_id || '-fn-body-1-part-' || i ELSE doc_id || '-whole' END AS chunk_id,
       md5(header || chr(10) || part) AS text_md5, giant AS is_part FROM r""")
def giant_split(spark, sf):
    d = spread(wh.table(spark, sf, "documents")).where(F.length("text") > 0)
    chunks = d.select(
        F.col("doc_id").cast("string").alias("file_id"), F.concat("doc_id", F.lit("-whole")).alias("chunk_id"),
        F.concat(F.lit("# File: "), "source", F.lit("\n")).alias("header"), F.col("text").alias("body"),
        F.lit("").alias("function_name"), F.lit("").alias("class_name"), F.lit(1).alias("start_line"))
    return chunking.split_giant_chunks(chunks).select("chunk_id", F.md5("text").alias("text_md5"), "is_part")


@query("c13_is_documented", """
SELECT o_orderkey, o_orderstatus = 'F' AS is_documented FROM orders""")
def documented(spark, sf):
    o = wh.table(spark, sf, "orders")
    body = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit('"""'), "o_orderpriority", F.lit('"""'))).when(
        F.col("o_orderstatus") == "O", F.lit("return 1")).otherwise(F.lit("x = '# no comment'"))
    text = F.concat(F.lit("# File: a\n# Function: b\n\n@cached\n"), F.when(F.col("o_custkey") % 2 == 0, "async ").otherwise(""), F.lit("def b():\n\n    "), body)
    return o.select("o_orderkey", chunking.is_documented(text, 2).alias("is_documented"))


@query("c15_tenant_key", """
SELECT l_orderkey, l_linenumber, l_partkey,
  'org' || (l_suppkey % 3) || ':repo:x/p' || l_partkey || CASE WHEN l_returnflag = 'A' THEN '::fn' || l_linenumber
     WHEN l_returnflag = 'N' THEN '::Cls' || l_linenumber ELSE ':c-' || l_orderkey END AS tenant_key FROM lineitem""")
def tenant_key(spark, sf):
    li = wh.table(spark, sf, "lineitem")
    fn = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("fn"), "l_linenumber"))
    cls = F.when(F.col("l_returnflag") != "R", F.concat(F.lit("Cls"), "l_linenumber")).otherwise("")
    key = chunking.chunk_tenant_key(
        F.concat(F.lit("org"), F.col("l_suppkey") % 3), F.lit("repo:x"), F.concat(F.lit("p"), "l_partkey"), fn, cls, F.concat(F.lit("c-"), "l_orderkey"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", key.alias("tenant_key"))


@query("c16_content_hash", "SELECT doc_id, sha256(text) AS chunk_hash, left(sha256(text), 32) AS document_hash FROM documents")
def hashes(spark, sf):
    return wh.table(spark, sf, "documents").select("doc_id", tx.content_hash("text").alias("chunk_hash"), tx.content_hash("text", 32).alias("document_hash"))


@query("c18_token_count", """
SELECT doc_id, len(regexp_extract_all(text, '[^\\s\\pZ\\x0b\\x1c-\\x1f\\x85]+'))::INT AS words FROM documents""")
def words(spark, sf):
    return wh.table(spark, sf, "documents").select("doc_id", tx.word_count("text").alias("words"))


@query("e20_url_redact", """
SELECT page_id, regexp_replace('fetch ' || replace(url, '://', '://user:tok' || page_id || '@') || ' failed',
   '(https?://|git://|ssh://|git@)[^/\\s@]+@', '\\1', 'g') AS shown FROM pages""")
def url_redact(spark, sf):
    secret = F.concat(F.lit("fetch "), F.replace(F.col("url"), F.lit("://"), F.concat(F.lit("://user:tok"), "page_id", F.lit("@"))), F.lit(" failed"))
    return wh.table(spark, sf, "pages").select("page_id", tx.redact_url(secret).alias("shown"))


@query("e21_repository_name", """
SELECT page_id, 'p' || page_id AS https_name, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, 'tool' || (page_id % 7) AS scp_name FROM pages""")
def repository_names(spark, sf):
    p = wh.table(spark, sf, "pages")
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
    https = F.concat(F.lit("https://"), host, F.lit("/Team/P"), "page_id", F.lit(".git/"))
    scp = F.concat(F.lit("git@"), host, F.lit(":team/Tool"), F.col("page_id") % 7, F.lit(".git"))
    return p.select("page_id", paths.repository_name(https).alias("https_name"), host.alias("host"), paths.repository_name(scp).alias("scp_name"))


@query("e22_url_validation", """
SELECT page_id,
  CASE WHEN page_id % 5 = 0 THEN 'unsupported_scheme' WHEN page_id % 5 = 1 THEN 'path_traversal' WHEN page_id % 5 = 2 THEN 'relative_path' ELSE '' END AS ingest_problem,
  CASE WHEN NOT url LIKE 'https://%' THEN 'not_https' WHEN contains(url, '?') OR contains(url, '#') THEN 'query_or_fragment' ELSE '' END AS remote_problem,
  (page_id % 4 <> 0) AS ref_ok FROM pages""")
def url_validation(spark, sf):
    p = wh.table(spark, sf, "pages")
    k = F.col("page_id") % 5
    address = F.when(k == 0, F.concat(F.lit("ftp://"), F.col("url"))).when(k == 1, F.concat(F.lit("/srv/../x"), "page_id")).when(
        k == 2, F.concat(F.lit("srv/x"), "page_id")).when(k == 3, F.col("url")).otherwise(F.lit("git@host:a/b.git"))
    ref = F.when(F.col("page_id") % 4 == 0, F.lit("bad..ref")).when(F.col("page_id") % 4 == 1, F.lit("")).otherwise(F.concat(F.lit("release/v1."), "page_id"))
    return p.select("page_id", F.coalesce(paths.repository_url_problem(address), F.lit("")).alias("ingest_problem"),
                    F.coalesce(paths.remote_url_problem("url"), F.lit("")).alias("remote_problem"), paths.git_ref_ok(ref).alias("ref_ok"))


@query("e23_secret_redact", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'api_key = "<redacted>"; ' || left(md5(text), 8) ELSE 'password: ''<redacted>'' ' || lang END AS shown FROM documents""")
def secret_redact(spark, sf):
    d = wh.table(spark, sf, "documents")
    a = F.concat(F.lit('api_key = "'), F.md5("text"), F.lit('"; '), F.left(F.md5("text"), F.lit(8)))
    b = F.concat(F.lit("password: 'x\"y"), "doc_id", F.lit("' "), "lang")
    return d.select("doc_id", tx.redact_secrets(F.when(F.col("doc_id") % 2 == 0, a).otherwise(b)).alias("shown"))


SQL_TREE_PATHS = """
tree AS (SELECT p_partkey, CASE p_size % 12
   WHEN 0 THEN 'src/' || p_partkey || '.py' WHEN 1 THEN 'docs/' || p_partkey || '.html' WHEN 2 THEN 'k8s/' || p_partkey || '.yaml'
   WHEN 3 THEN 'a/tests/t' || p_partkey || '.py' WHEN 4 THEN 'm' || p_partkey || '/package.json' WHEN 5 THEN 'db/migrations/' || p_partkey || '.sql'
   WHEN 6 THEN 'x' || p_partkey || '/Dockerfile' WHEN 7 THEN 'conf/' || p_partkey || '.toml' WHEN 8 THEN 'README_' || p_partkey || '.md'
   WHEN 9 THEN 'w' || p_partkey || '/style.css' WHEN 10 THEN 'ui/b' || p_partkey || '.spec.tsx' ELSE 'c' || p_partkey || '/.env' END AS path,
   p_type, p_brand, p_retailprice FROM part)"""


def tree_paths(spark, sf):
    p = wh.table(spark, sf, "part")
    k, m = F.col("p_partkey"), F.col("p_size") % 12
    forms = ["src/%d.py", "docs/%d.html", "k8s/%d.yaml", "a/tests/t%d.py", "m%d/package.json", "db/migrations/%d.sql",
             "x%d/Dockerfile", "conf/%d.toml", "README_%d.md", "w%d/style.css", "ui/b%d.spec.tsx", "c%d/.env"]
    path = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        path = F.when(m == i, F.format_string(form, k)).otherwise(path)
    return p.select("p_partkey", path.alias("path"), "p_type", "p_brand", "p_retailprice")


@query("e24_category", "WITH " + SQL_TREE_PATHS + """
SELECT p_partkey, CASE split_part(path, '/', 1) WHEN 'src' THEN 'source' WHEN 'docs' THEN 'documentation' WHEN 'k8s' THEN 'deployment'
  WHEN 'a' THEN 'test' WHEN 'db' THEN 'migration' WHEN 'conf' THEN 'configuration' WHEN 'ui' THEN 'test'
  ELSE CASE WHEN path LIKE 'm%' THEN 'manifest' WHEN path LIKE 'x%' THEN 'deployment' WHEN path LIKE 'README%' THEN 'documentation' ELSE 'other_text' END END AS category,
  path LIKE '%/.env' AS is_sensitive,
  CASE WHEN path LIKE '%.py' THEN 'Python' WHEN path LIKE '%.sql' THEN 'SQL' WHEN path LIKE '%.tsx' THEN 'TypeScript' ELSE '' END AS language FROM tree""")
def categories(spark, sf):
    t = tree_paths(spark, sf)
    return t.select("p_partkey", paths.category("path").alias("category"), paths.is_sensitive("path").alias("is_sensitive"),
                    F.coalesce(paths.language("path"), F.lit("")).alias("language"))


@query("e24_frameworks", """
SELECT s_suppkey, concat_ws(',', CASE WHEN s_suppkey % 5 = 0 THEN 'Django' END, CASE WHEN s_suppkey % 2 = 0 THEN 'FastAPI' END, CASE WHEN s_suppkey % 3 = 0 THEN 'React' END) AS frameworks FROM supplier""")
def framework_hits(spark, sf):
    s = wh.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    text = F.concat_ws("\n", "s_name", F.when(k % 2 == 0, "FastAPI==0.1"), F.when(k % 3 == 0, '"react": "18"'), F.when(k % 5 == 0, "django>4"))
    return s.select("s_suppkey", F.array_join(paths.frameworks(text), ",").alias("frameworks"))


@query("e1_document_classifier", "WITH " + SQL_TREE_PATHS + """
SELECT p_partkey, path LIKE 'docs/%' OR path LIKE 'README%' AS is_document, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '_root' END AS module FROM tree""")
def classifier(spark, sf):
    return tree_paths(spark, sf).select("p_partkey", paths.is_document("path").alias("is_document"), paths.module_of("path").alias("module"))


@query("e2_modules", """
SELECT DISTINCT p_type AS organization_id, 'repo:' || lower(p_brand) AS repository_id,
  CASE WHEN p_partkey % 10 = 0 THEN '_root' ELSE split_part(p_name, ' ', 1) END AS module_name FROM part""")
def module_rows(spark, sf):
    return wh.files(spark, sf).select("organization_id", "repository_id", "module_name").distinct()


@query("s24_line_range", """
SELECT doc_id, left(array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)), 1600) AS excerpt FROM documents""")
def line_ranges(spark, sf):
    return wh.table(spark, sf, "documents").select("doc_id", tx.line_range("text", F.lit(2), F.lit(4), 1600).alias("excerpt"))


@query("r8_truncate", """
SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE left(text, 250) || ' ... ' || right(text, 150) END AS shown FROM documents""")
def truncated(spark, sf):
    return wh.table(spark, sf, "documents").select("doc_id", tx.head_tail("text").alias("shown"))


@query("u5_question_split", """
SELECT conv_id, turn, trim(regexp_replace(x, '^\\s*\\d+[.)]\\s*', '')) AS question FROM (
  SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS x FROM conversations) WHERE trim(x) <> ''""")
def question_split(spark, sf):
    rows = wh.table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("_x"))
    return rows.where(F.trim("_x") != "").select("conv_id", "turn", F.trim(F.regexp_replace("_x", r"^\s*\d+[.)]\s*", "")).alias("question"))
