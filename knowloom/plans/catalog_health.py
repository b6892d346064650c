"""Registered queries: ownership, coverage, health, gaps, questions, onboarding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import health as h
from ..sources import warehouse as wh
from .catalog_graph import ORG, SQL_GRAPH
from .registry import query


def wide_context(spark, sf):
    return h.module_context(wh.modules(spark, sf), wh.symbols(spark, sf), wh.linked_documents(spark, sf), wh.ownership(spark, sf))


def thin_context(spark, sf):
    """Modules per (brand, size); whose commits a module's size makes unsigned or the work of one to four people."""
    p = wh.table(spark, sf, "part").select("p_partkey", "p_size", F.col("p_brand").alias(ORG), F.concat(F.lit("m"), F.col("p_size").cast("string")).alias("module_id"))
    mods = p.select(ORG, "module_id").distinct().withColumns({"module_name": F.col("module_id"), "repository_id": F.col(ORG)})
    li = wh.table(spark, sf, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    author = F.when(F.col("p_size") % 7 != 0, F.concat(F.lit("s"), (F.col("l_suppkey") % (1 + F.col("p_size") % 4)).cast("string")))
    owns = li.withColumn("author_email", author).where("author_email is not null").groupBy(ORG, "module_id", "author_email").agg(F.count(F.lit(1)).alias("commit_count"))
    owns = owns.withColumn("author_name", F.col("author_email"))
    fns = li.select(ORG, "module_id", F.concat(F.lit("f"), "l_orderkey", F.lit("_"), "l_linenumber").alias("function_name"),
                      F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")).alias("function_id"),
                      F.when(F.col("l_linestatus") == "O", "C").otherwise("").alias("parent_class"), F.concat(F.lit("p"), "l_partkey").alias("path"),
                      (F.col("l_quantity") * 8).cast("int").alias("token_count"), (F.col("l_returnflag") != "N").alias("is_documented"))
    c = wh.table(spark, sf, "customer").join(p, F.col("c_custkey") == F.col("p_partkey"))
    docs = c.select(ORG, "module_id", F.col("c_name").alias("doc_id"), F.when(F.col("c_nationkey") % 3 == 0, "README.md").otherwise("guide.md").alias("filename"))
    return h.module_context(mods, fns, docs, owns), fns


SQL_THIN = """
WITH p AS (SELECT p_partkey, p_size, p_brand AS organization_id, 'm' || p_size AS module_id FROM part),
mods AS (SELECT DISTINCT organization_id, module_id, module_id AS module_name FROM p),
work AS (SELECT l.*, organization_id, module_id, CASE WHEN p_size % 7 <> 0 THEN 's' || (l_suppkey % (1 + p_size % 4)) END AS author FROM lineitem l JOIN p ON l_partkey = p_partkey),
o AS (SELECT organization_id, module_id, count(DISTINCT author) AS bus_factor, min(author) AS sole_owner FROM work GROUP BY ALL),
fns AS (SELECT organization_id, module_id, 'f' || l_orderkey || '_' || l_linenumber AS function_name,
  l_partkey || '-' || l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS function_id, CASE WHEN l_linestatus = 'O' THEN 'C' ELSE '' END AS parent_class,
  'p' || l_partkey AS path, (l_quantity * 8)::INT AS token_count, l_returnflag <> 'N' AS is_documented FROM work),
fc AS (SELECT organization_id, module_id, count(*) AS total, count(*) FILTER (is_documented) AS documented, count(*) FILTER (parent_class = '') AS entries FROM fns GROUP BY ALL),
d AS (SELECT organization_id, module_id, count(*) AS linked_docs, bool_or(c_nationkey % 3 = 0) AS has_readme FROM customer JOIN p ON c_custkey = p_partkey GROUP BY ALL),
ctx AS (SELECT m.*, coalesce(total, 0) AS total, coalesce(total - documented, 0) AS undocumented, coalesce(entries, 0) AS entries,
   CASE WHEN coalesce(total, 0) = 0 THEN 100.0 ELSE round(documented / total * 100, 1) END AS coverage_pct,
   coalesce(linked_docs, 0) AS linked_docs, coalesce(has_readme, false) AS has_readme, coalesce(bus_factor, 0) AS bus_factor, sole_owner
  FROM mods m LEFT JOIN o USING (organization_id, module_id) LEFT JOIN fc USING (organization_id, module_id) LEFT JOIN d USING (organization_id, module_id)),
score AS (SELECT *, least(100.0, coverage_pct + CASE WHEN has_readme THEN 10 ELSE 0 END + least(linked_docs * 5, 15)) AS doc_score,
   round(least(bus_factor / 3.0, 1.0) * 100, 1)::DOUBLE AS ownership_score FROM ctx),
health AS (SELECT *, round(0.4 * doc_score + 0.6 * ownership_score, 1) AS overall_score FROM score)
"""


@query("e3_ownership", SQL_GRAPH + "SELECT organization_id, file_id, author_email, author_name, commit_count, last_commit_at FROM owns")
def ownership(spark, sf):
    return wh.ownership(spark, sf).select(ORG, "file_id", "author_email", "author_name", "commit_count", "last_commit_at")


@query("e4_last_touch", SQL_GRAPH + """
SELECT organization_id, file_id, (arg_max(author_email, k)) AS author_email, max(committed_at) AS committed_at, (arg_max(sha, k)) AS sha, count(*) AS commit_count
FROM (SELECT *, row(committed_at, sha, author_email) AS k FROM commits) GROUP BY ALL""")
def last_touch(spark, sf):
    return h.last_touch(wh.commits(spark, sf)).select(ORG, "file_id", F.lower("author_email").alias("author_email"), "committed_at", "sha", "commit_count")


@query("e5_authors", SQL_GRAPH + "SELECT DISTINCT organization_id, author_email, author_name, 'person:' || author_email AS person_id FROM commits")
def authors(spark, sf):
    return h.people(wh.commits(spark, sf))


@query("s6_newest_commits", SQL_GRAPH + """
, heads AS (SELECT organization_id, repository_id, sha, max(committed_at) AS newest FROM commits GROUP BY ALL),
kept AS (SELECT *, row_number() OVER (PARTITION BY organization_id, repository_id ORDER BY newest DESC, sha DESC) AS r FROM heads QUALIFY r <= 100)
SELECT c.organization_id, c.repository_id, count(*) AS touches, count(DISTINCT c.sha) AS commits, min(committed_at) AS oldest FROM commits c JOIN kept USING (organization_id, repository_id, sha) GROUP BY ALL""")
def newest(spark, sf):
    c = h.newest_commits(wh.commits(spark, sf), 100)
    return c.groupBy(ORG, "repository_id").agg(F.count(F.lit(1)).alias("touches"), F.countDistinct("sha").alias("commits"), F.min("committed_at").alias("oldest"))


@query("e14_authored", SQL_GRAPH + """
, t AS (SELECT organization_id, repository_id, file_id, arg_max(author_email, row(committed_at, sha, author_email)) AS m, count(*) AS n FROM commits GROUP BY ALL)
SELECT s.organization_id, s.symbol_id, t.m AS author_email, n AS commit_count
FROM (SELECT organization_id, repository_id, file_id, file_id || '::' || symbol_name AS symbol_id FROM cls UNION ALL SELECT organization_id, repository_id, file_id, function_id FROM syms) s JOIN t USING (organization_id, repository_id, file_id)""")
def authored(spark, sf):
    c = wh.commits(spark, sf)
    own = [ORG, "repository_id", "file_id", "symbol_id"]
    return h.authored(wh.classes(spark, sf).select(own).unionByName(wh.symbols(spark, sf).select(own)), h.last_touch(c), c).select(ORG, "symbol_id", "author_email", "commit_count")


@query("e15_first_per_key", SQL_GRAPH + "SELECT organization_id, function_id, start_line, end_line, parent_class, token_count, is_documented FROM syms")
def first_symbols(spark, sf):
    return wh.symbols(spark, sf).select(ORG, "function_id", "start_line", "end_line", "parent_class", "token_count", "is_documented")


@query("e16_method_of", SQL_GRAPH + "SELECT organization_id, function_id, file_id || '::' || parent_class AS class_id FROM syms WHERE parent_class <> ''")
def method_of(spark, sf):
    return h.methods_of(wh.symbols(spark, sf), wh.classes(spark, sf))


@query("a2_key_files", SQL_GRAPH + """
SELECT f.organization_id, f.file_id, (SELECT count(*) FROM syms s WHERE s.organization_id = f.organization_id AND s.file_id = f.file_id) AS function_count,
  (SELECT count(*) FROM cls s WHERE s.organization_id = f.organization_id AND s.file_id = f.file_id) AS class_count FROM files f""")
def key_files(spark, sf):
    return h.key_files(wh.files(spark, sf), wh.symbols(spark, sf), wh.classes(spark, sf)).select(ORG, "file_id", "function_count", "class_count")


@query("a3_entry_points", SQL_GRAPH + "SELECT organization_id, function_id, is_documented FROM syms WHERE parent_class = ''")
def entry_points(spark, sf):
    return h.entry_points(wh.symbols(spark, sf)).select(ORG, "function_id", "is_documented")


@query("a4_coverage", SQL_GRAPH + """
SELECT organization_id, module_id, count(*) AS total_functions, count(*) FILTER (is_documented) AS documented_functions,
  round(count(*) FILTER (is_documented) / count(*) * 100, 1) AS coverage_pct FROM syms GROUP BY ALL""")
def coverage(spark, sf):
    return h.coverage(wh.symbols(spark, sf), wh.symbols(spark, sf).select(ORG, "module_id").distinct()).select(
        ORG, "module_id", "total_functions", "documented_functions", "coverage_pct")


@query("a5_has_readme", SQL_GRAPH + """
SELECT organization_id, module_id, coalesce(bool_or(filename IN ('README.md', 'CONTRIBUTING.md')), false) AS has_readme, count(doc_id) AS linked_docs
FROM mods LEFT JOIN docs USING (organization_id, module_id) GROUP BY ALL""")
def has_readme(spark, sf):
    return h.documentation(wh.linked_documents(spark, sf), wh.modules(spark, sf)).select(ORG, "module_id", "has_readme", "linked_docs")


@query("a7_bus_factor", SQL_THIN + """
SELECT organization_id, module_id, bus_factor, ownership_score, bus_factor = 1 AS sole_owner_risk, bus_factor = 0 AS unowned FROM health""")
def bus_factor(spark, sf):
    return h.health_scores(thin_context(spark, sf)[0]).select(ORG, "module_id", "bus_factor", "ownership_score", "sole_owner_risk", "unowned")


@query("a8_health", SQL_THIN + "SELECT organization_id, module_id, coverage_pct, doc_score, overall_score FROM health")
def health(spark, sf):
    return h.health_scores(thin_context(spark, sf)[0]).select(ORG, "module_id", "coverage_pct", "doc_score", "overall_score")


@query("a9_gaps", SQL_THIN + """
SELECT organization_id, module_id, concat_ws('; ',
  CASE WHEN coverage_pct < 80 AND total > 0 THEN undocumented || ' of ' || total || ' functions missing docstrings (' || printf('%.1f', coverage_pct) || '% coverage)' END,
  CASE WHEN NOT has_readme THEN 'No README or contributing guide found in this module' END,
  CASE WHEN linked_docs = 0 THEN 'No linked business documents (PRDs, BRDs) found for this module' END,
  CASE bus_factor WHEN 0 THEN 'No code owners found — module has no git authorship data' WHEN 1 THEN 'Bus factor is 1 — only 1 contributor owns this module (high KT risk)'
    WHEN 2 THEN 'Bus factor is 2 — only 2 contributors own this module' END) AS gaps FROM health""")
def gaps(spark, sf):
    return h.health_scores(thin_context(spark, sf)[0]).select(ORG, "module_id", F.array_join("gaps", "; ").alias("gaps"))


@query("a10_worst_modules", SQL_THIN + """
SELECT organization_id, module_id, overall_score, row_number() OVER (PARTITION BY organization_id ORDER BY overall_score, module_id)::INT AS position FROM health QUALIFY position <= 20""")
def worst(spark, sf):
    return h.worst_modules(h.health_scores(thin_context(spark, sf)[0])).select(ORG, "module_id", "overall_score", "position")


SQL_SIGNALS = SQL_THIN + """
, u AS (SELECT * FROM fns WHERE NOT is_documented),
sig AS (
  SELECT organization_id, module_id, 1 AS severity, 'complex_undocumented' AS type, function_name AS entity, function_id AS seq,
    'Function ''' || function_name || ''' (' || token_count || ' tokens) is undocumented and complex' AS description FROM u WHERE token_count > 200
  UNION ALL SELECT organization_id, module_id, 4, 'undocumented_method', parent_class || '.' || function_name, function_id,
    'Method ''' || parent_class || '.' || function_name || ''' is undocumented' FROM u WHERE token_count <= 200 AND parent_class <> ''
  UNION ALL SELECT organization_id, module_id, 3, 'undocumented_function', function_name, function_id,
    'Entry function ''' || function_name || ''' in ''' || path || ''' has no docstring' FROM u WHERE parent_class = ''
  UNION ALL SELECT organization_id, module_id, 2, 'sole_owner_file', sole_owner, '', 'All files in module are owned solely by ''' || sole_owner || ''' (bus-factor risk; ownership is file-level last-author, not per-function)' FROM ctx WHERE bus_factor = 1
  UNION ALL SELECT organization_id, module_id, 2, 'no_owners', '', '', 'No git commit authorship records found for files in this module' FROM ctx WHERE bus_factor = 0
  UNION ALL SELECT organization_id, module_id, 5, 'no_linked_docs', '', '', 'No documentation files linked to this module' FROM ctx WHERE linked_docs = 0
  UNION ALL SELECT organization_id, module_id, 6, 'no_readme', '', '', 'Module has no linked README or overview document' FROM ctx WHERE NOT has_readme
  UNION ALL SELECT organization_id, module_id, 7, 'low_doc_coverage', coverage_pct::VARCHAR, '', 'Module function documentation coverage is low (' || printf('%.1f', coverage_pct) || '%)' FROM ctx WHERE coverage_pct < 50 AND total > 0
  UNION ALL SELECT organization_id, module_id, 9, 'cross_module_deps_unknown', '', '', 'Cross-module dependency graph not yet available' FROM ctx),
placed AS (SELECT *, row_number() OVER (PARTITION BY organization_id, module_id ORDER BY severity, seq)::INT AS position FROM sig QUALIFY position <= 15)
"""


def signals(spark, sf):
    ctx, fns = thin_context(spark, sf)
    return h.gap_signals(ctx, fns)


@query("a11_signals", SQL_SIGNALS + "SELECT organization_id, module_id, position, type, severity, entity, description FROM placed")
def signal_rows(spark, sf):
    return signals(spark, sf)


SQL_ASKED = SQL_SIGNALS + """
, nth AS (SELECT *, row_number() OVER (PARTITION BY organization_id, module_id, type ORDER BY position) AS nth FROM placed),
asked AS (SELECT *, row_number() OVER (PARTITION BY organization_id, module_id ORDER BY position)::INT AS number FROM nth
  WHERE (type IN ('complex_undocumented', 'sole_owner_file', 'no_owners') OR nth = 1) QUALIFY number <= 8)
"""


@query("a12_questions", SQL_ASKED + """
SELECT organization_id, module_id, number, type, number || '. ' || CASE type
  WHEN 'complex_undocumented' THEN 'Walk me through `' || entity || '` — it is a large function with no docstring. What are its non-obvious behaviors or edge cases?'
  WHEN 'undocumented_function' THEN 'What does `' || entity || '` do, and what was the design rationale behind its signature?'
  WHEN 'undocumented_method' THEN 'What is the expected contract and state lifecycle for `' || entity || '`?'
  WHEN 'sole_owner_file' THEN 'You are the primary committer for these files (' || entity || '). What unwritten rules or operational gotchas should a maintainer know?'
  WHEN 'no_owners' THEN 'No active git commit owner was found for this module. Who originally authored it and who can be consulted for legacy context?'
  WHEN 'no_linked_docs' THEN 'There are no linked documentation files for this module. Where is tribal knowledge or architectural intent recorded?'
  WHEN 'no_readme' THEN 'There is no README for this module. What is the recommended entry path for exploring this codebase?'
  WHEN 'low_doc_coverage' THEN 'Documentation coverage across this module is under 50%. Which specific undocumented areas have the highest risk of regression?'
  ELSE 'What other modules or external APIs does this module interface with, and are there known coupling issues?' END AS question FROM asked""")
def questions(spark, sf):
    return h.rule_questions(signals(spark, sf))


@query("a13_question_lists", SQL_ASKED + """
, r AS (SELECT organization_id, module_id, count(*) AS signal_count, count(*) FILTER (type <> 'cross_module_deps_unknown') AS real FROM placed GROUP BY ALL),
n AS (SELECT organization_id, module_id, count(*) AS n FROM asked GROUP BY ALL)
SELECT organization_id, module_id, signal_count, CASE WHEN real = 0 THEN 'no_gaps_detected' ELSE 'rule_based_fallback' END AS generation_method,
  (CASE WHEN real = 0 THEN 1 ELSE n END)::INT AS question_lines FROM r JOIN n USING (organization_id, module_id)""")
def question_lists(spark, sf):
    return h.question_lists(signals(spark, sf)).select(ORG, "module_id", "signal_count", "generation_method", F.size(F.split("questions", "\n")).alias("question_lines"))


@query("a14_grounding", SQL_GRAPH + """
, f AS (SELECT organization_id, module_id, file_id, path, p_partkey FROM files), m AS (SELECT DISTINCT organization_id, module_id, author_email FROM owns)
SELECT f.organization_id, f.module_id, f.file_id, CASE WHEN p_partkey % 3 = 1 THEN 'grounding_warning' WHEN p_partkey % 3 = 2 AND NOT EXISTS (
   SELECT 1 FROM m WHERE m.organization_id = f.organization_id AND m.module_id = f.module_id AND m.author_email = 'supplier.' || printf('%09d', p_partkey % 100) || '@example.com') THEN 'grounding_warning' ELSE 'ok' END AS generation_quality FROM f""")
def grounding(spark, sf):
    f = wh.files(spark, sf)
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("Read "), "path", F.lit(" and README.md first."))).when(k % 3 == 1, F.lit("Start with Missing_File.py then.")).otherwise(
        F.format_string("Ask Supplier.%09d@example.com about it.", k % 100))
    # the text belongs to a file here, so the file stands for the module in the check
    g_ = f.select(ORG, F.col("file_id").alias("module_id"), F.col("module_id").alias("_m"), text.alias("generated_text"))
    people = wh.ownership(spark, sf).select(ORG, "module_id", "author_email").distinct().join(
        f.select(ORG, "module_id", "file_id", "p_partkey"), [ORG, "module_id"]).where(
        F.col("author_email") == F.format_string("supplier.%09d@example.com", k % 100)).select(ORG, F.col("file_id").alias("module_id"), "author_email")
    known = f.select(ORG, F.col("file_id").alias("module_id"), "path")
    return h.grounding(g_, people, known).select(ORG, F.col("_m").alias("module_id"), F.col("module_id").alias("file_id"), "generation_quality")


@query("a15_first_tasks", SQL_THIN + """
SELECT organization_id, module_id, 1 AS seq, 'high' AS priority, 'Create a README.md for module ''' || module_name || '''' AS description FROM ctx WHERE NOT has_readme
UNION ALL SELECT organization_id, module_id, 2, 'medium', 'Add docstrings to ' || undocumented || ' undocumented functions' FROM ctx WHERE undocumented > 0
UNION ALL SELECT organization_id, module_id, 3, 'low', 'Identify and document main module entry points' FROM ctx WHERE entries = 0""")
def first_tasks(spark, sf):
    return h.first_tasks(thin_context(spark, sf)[0]).select(ORG, "module_id", "seq", "priority", "description")


def packs(spark, sf):
    mods, syms, cls, docs, owns = wh.modules(spark, sf), wh.symbols(spark, sf), wh.classes(spark, sf), wh.linked_documents(spark, sf), wh.ownership(spark, sf)
    ctx = h.module_context(mods, syms, docs, owns)
    return h.onboarding_packs(ctx, h.key_files(wh.files(spark, sf), syms, cls), h.module_owners(owns), docs, h.first_tasks(ctx), h.entry_points(syms))


SQL_PACK = SQL_GRAPH + """
, nf AS (SELECT organization_id, module_id, count(*) AS n, md5(string_agg(path, ',' ORDER BY path)) AS listed FROM files GROUP BY ALL),
no AS (SELECT organization_id, module_id, least(count(DISTINCT author_email), 10) AS n FROM owns GROUP BY ALL),
nd AS (SELECT organization_id, module_id, count(*) AS n, md5(string_agg(relative_path, ',' ORDER BY relative_path, doc_id)) AS listed, bool_or(filename IN ('README.md', 'CONTRIBUTING.md')) AS readme FROM docs GROUP BY ALL),
ne AS (SELECT organization_id, module_id, count(*) FILTER (parent_class = '') AS n, md5(string_agg(function_name, ',' ORDER BY function_id) FILTER (parent_class = '')) AS listed, count(*) FILTER (NOT is_documented) AS u, count(*) FILTER (parent_class = '') AS e FROM syms GROUP BY ALL),
pack AS (SELECT m.organization_id, m.module_id, m.module_name, nf.n AS files, coalesce(no.n, 0) AS owners, coalesce(nd.n, 0) AS docs, coalesce(ne.n, 0) AS entries, nf.listed AS file_list, coalesce(nd.listed, '') AS doc_list, coalesce(ne.listed, '') AS entry_list,
  (CASE WHEN NOT coalesce(readme, false) THEN 1 ELSE 0 END + CASE WHEN coalesce(u, 0) > 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(e, 0) = 0 THEN 1 ELSE 0 END) AS tasks
 FROM mods m JOIN nf USING (organization_id, module_id) LEFT JOIN no USING (organization_id, module_id) LEFT JOIN nd USING (organization_id, module_id) LEFT JOIN ne USING (organization_id, module_id))
"""


@query("a16_onboarding_pack", SQL_PACK + "SELECT organization_id, module_id, files, owners, docs, entries, tasks, file_list, doc_list, entry_list FROM pack")
def onboarding(spark, sf):
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    listed = lambda c, field: F.coalesce(F.when(F.size(c) > 0, F.md5(F.array_join(F.transform(c, lambda x: x[field]), ","))), F.lit(""))
    return packs(spark, sf).select(ORG, "module_id", n("key_files").alias("files"), n("who_to_talk_to").alias("owners"), n("existing_docs").alias("docs"),
                                   n("entry_points").alias("entries"), n("suggested_first_tasks").alias("tasks"),
                                   listed("key_files", "path").alias("file_list"), listed("existing_docs", "relative_path").alias("doc_list"), listed("entry_points", "function_name").alias("entry_list"))


@query("a17_onboarding_markdown", SQL_PACK + """
SELECT organization_id, module_id, '# Developer Onboarding Pack: `' || module_name || '`' AS title, 8 + docs AS heading_lines FROM pack""")
def onboarding_md(spark, sf):
    md = h.onboarding_markdown(packs(spark, sf))
    lines = F.split("markdown", "\n")
    return md.select(ORG, "module_id", F.element_at(lines, 1).alias("title"),
                     F.size(F.filter(lines, lambda l: l.rlike("^#{1,3} "))).cast("long").alias("heading_lines"))


@query("a25_average_health", SQL_THIN + "SELECT organization_id, round(avg(overall_score))::INT AS average_health FROM health GROUP BY ALL")
def average(spark, sf):
    return h.average_health(h.health_scores(thin_context(spark, sf)[0]))


@query("a1_module_context", SQL_GRAPH + """
, fc AS (SELECT organization_id, module_id, count(*) AS t, count(*) FILTER (is_documented) AS d, count(*) FILTER (parent_class = '') AS e FROM syms GROUP BY ALL),
dc AS (SELECT organization_id, module_id, count(*) AS n, bool_or(filename IN ('README.md', 'CONTRIBUTING.md')) AS r FROM docs GROUP BY ALL),
oc AS (SELECT organization_id, module_id, count(DISTINCT author_email) AS b FROM owns GROUP BY ALL)
SELECT m.organization_id, m.module_id, coalesce(t, 0) AS total_functions, coalesce(e, 0) AS entry_point_count, coalesce(n, 0) AS linked_docs, coalesce(r, false) AS has_readme, coalesce(b, 0) AS bus_factor,
  CASE WHEN coalesce(t, 0) = 0 THEN 100.0 ELSE round(d / t * 100, 1) END AS coverage_pct FROM mods m LEFT JOIN fc USING (organization_id, module_id) LEFT JOIN dc USING (organization_id, module_id) LEFT JOIN oc USING (organization_id, module_id)""")
def context(spark, sf):
    return wide_context(spark, sf).select(ORG, "module_id", "total_functions", "entry_point_count", "linked_docs", "has_readme", "bus_factor", "coverage_pct")
