"""Registered queries: document generation, multiset contracts, claims, citations, acceptance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import render, source_facts as sfx, verify as vf
from ..session import staged
from ..sources import derived_code as dc, warehouse as wh
from . import analysis
from .catalog_code import SQL_SVC, service_facts
from .registry import query

ORG = "organization_id"
COMMIT = "c0ffee"


def runs(spark, sf):
    """One row per repository, made once: each fixed section of the documents reads it."""
    return staged(dc.service_tree(spark, sf).select(*sfx.REPO).distinct()).withColumns({"repository_name": F.concat_ws("/", ORG, "repository_id"), "commit_sha": F.lit(COMMIT)})


def generated(spark, sf):
    tree = dc.service_tree(spark, sf)
    deps = dc.build_files(spark, sf).withColumn("repository_id", F.lit("repo:orders"))
    found = analysis.analyze(tree, runs(spark, sf), COMMIT, deps)
    return found["lines"], tree, found["facts"]


SQL_LINES = SQL_SVC + """
, n AS (SELECT organization_id, count(*) AS orders FROM svc GROUP BY ALL),
want AS (SELECT organization_id, 'database_api_reference' AS document_id, 21 AS section, orders AS lines FROM n UNION ALL SELECT organization_id, 'database_api_reference', 31, orders FROM n
  UNION ALL SELECT organization_id, 'business_logic', 21, orders * 3 FROM n UNION ALL SELECT organization_id, 'business_logic', 31, orders FROM n
  UNION ALL SELECT organization_id, 'developer_operations', 21, orders FROM n)
"""


@query("s21_rendered_documents", SQL_LINES + "SELECT organization_id, document_id, section, lines FROM want")
def rendered(spark, sf):
    lines = generated(spark, sf)[0]
    wanted = (((F.col("document_id") == "database_api_reference") & F.col("section").isin(21, 31)) | ((F.col("document_id") == "business_logic") & F.col("section").isin(21, 31))
              | ((F.col("document_id") == "developer_operations") & (F.col("section") == 21)))
    return lines.where(wanted).groupBy(ORG, "document_id", "section").agg(F.count(F.lit(1)).alias("lines"))


@query("v5_endpoint_rows", SQL_SVC + """
SELECT organization_id, '| **GET** | `/api' || (c % 10) || '/items' || (k % 100) || '/{key}` | `' || module || '.fetch_' || k || '` | python_web | high | `' || path || ':L20` (`evidence:'
  || left(sha256('c0ffee:evidence:' || path || ':20:route:get:/api' || (c % 10) || '/items' || (k % 100) || '/{key}:' || module || '.fetch_' || k), 20) || '`) |' AS line FROM svc""")
def endpoint_rows(spark, sf):
    facts = sfx.with_ids(service_facts(spark, sf, ("route",)), F.lit(COMMIT))
    return render.routes_of(facts).select(ORG, render.endpoint_row().alias("line"))


@query("v5_behaviour_rows", SQL_SVC + "SELECT organization_id, '| `' || module || '.Order' || k || '.save` | 1 | 1 | 1 | 1 | `' || path || ':L13` |' AS line FROM svc")
def behaviour_rows(spark, sf):
    return sfx.other_behaviours(staged(service_facts(spark, sf, sfx.WORKFLOW_FACTS))).select(ORG, render.behaviour_row().alias("line"))


@query("a18_capabilities", SQL_SVC + """
SELECT organization_id, 'api' || (c % 10) AS capability, count(*) AS route_count, 'GET' AS methods FROM svc GROUP BY ALL""")
def capabilities(spark, sf):
    return render.route_capabilities(render.routes_of(sfx.with_ids(service_facts(spark, sf, ("route",)), F.lit(COMMIT)))).select(
        ORG, "capability", "route_count", F.array_join("methods", ",").alias("methods"))


@query("a19_language_totals", SQL_SVC + "SELECT organization_id, 'Python' AS language, (SELECT count(*) FROM svc s WHERE s.organization_id = o.organization_id) + (SELECT count(*) FROM util u WHERE u.organization_id = o.organization_id) AS files FROM (SELECT DISTINCT organization_id FROM svc) o")
def language_totals(spark, sf):
    t = dc.service_tree(spark, sf)
    return render.language_totals(sfx.components(t, sfx.extract_facts(t))).select(ORG, "language", "files")


@query("a20_config_dedup", SQL_SVC + "SELECT DISTINCT organization_id, 'KEY_' || (c % 30) AS name, path, 21 AS line FROM svc")
def config_dedup(spark, sf):
    f = staged(service_facts(spark, sf, ("config",)))  # both sides read it; the files are parsed once
    return render.distinct_config(f.unionByName(f)).select(ORG, "name", "path", "line")


def events_by_half(spark, sf):
    e = wh.table(spark, sf, "events").select((F.col("user_id") % 10).alias("g"), (F.col("user_id") % 2 == 0).alias("_h"), F.concat_ws(":", "event_type", "props").alias("line"))
    e = e.withColumn("g", F.floor(F.col("g") / 2))
    return e.where("_h").drop("_h"), e.where("not _h").drop("_h")


SQL_HALVES = "WITH e AS (SELECT (user_id % 10) // 2 AS g, user_id % 2 = 0 AS h, event_type || ':' || props AS line FROM events), a AS (SELECT g, line FROM e WHERE h), b AS (SELECT g, line FROM e WHERE NOT h)"


@query("v1_multiset_diff", SQL_HALVES + """
SELECT 'missing' AS side, g, line FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'unexpected', g, line FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def multiset_diff(spark, sf):
    missing, extra = vf.multiset_difference(*events_by_half(spark, sf))
    return missing.select(F.lit("missing").alias("side"), "g", "line").unionByName(extra.select(F.lit("unexpected").alias("side"), "g", "line"))


@query("v2_contract_metric", SQL_HALVES + """
, m AS (SELECT g, count(*) AS n FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b) GROUP BY g)
SELECT g, (SELECT count(*) FROM a WHERE a.g = m.g) AS expected, n AS matched, (SELECT count(*) FROM b WHERE b.g = m.g) - n AS unexpected, 'mismatch' AS status FROM m""")
def contract_metric(spark, sf):
    return vf.contract_metrics(*events_by_half(spark, sf), ["g"]).drop("missing")


@query("v2_contract_examples", SQL_HALVES + """
, d AS (SELECT 'missing' AS kind, g, line FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'unexpected', g, line FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
SELECT kind, g, line, row_number() OVER (PARTITION BY kind, g ORDER BY line)::INT AS position FROM d QUALIFY position <= 10""")
def contract_examples(spark, sf):
    return vf.contract_examples(*events_by_half(spark, sf), ["g"])


def sectioned(spark, sf):
    """conversations as small Markdown texts with a table inside a section."""
    c = wh.table(spark, sf, "conversations")
    md = F.concat(F.lit("# T\n\n## Before\n\nx\n## Rows\n\n| A | B |\n|---|---|\n\n"), F.format_string("| %d | %s |\n| end | %d |\n", "conv_id", "role", "turn"),
                  F.lit("tail\n| not | row |\n### Deeper\n\ny\n## After\n"), "text")
    return c.select("conv_id", "turn", "role", md.alias("md"))


@query("v3_markdown_section", """
SELECT conv_id, turn, chr(10) || '| A | B |' || chr(10) || '|---|---|' || chr(10) || chr(10) || '| ' || conv_id || ' | ' || role || ' |' || chr(10) || '| end | ' || turn || ' |' || chr(10)
 || 'tail' || chr(10) || '| not | row |' || chr(10) || '### Deeper' || chr(10) || chr(10) || 'y' AS section FROM conversations""")
def markdown_section(spark, sf):
    return sectioned(spark, sf).select("conv_id", "turn", vf.section_of("md", F.lit("## Rows")).alias("section"))


@query("v4_table_rows", "SELECT conv_id, turn, '| ' || conv_id || ' | ' || role || ' |' || chr(10) || '| end | ' || turn || ' |' AS rows FROM conversations")
def table_rows(spark, sf):
    return sectioned(spark, sf).select("conv_id", "turn", F.array_join(vf.table_rows_of(vf.section_of("md", F.lit("## Rows")), F.lit("| A | B |")), "\n").alias("rows"))


def made_claims(spark, sf):
    t = dc.service_tree(spark, sf)
    f = sfx.with_ids(staged(sfx.extract_facts(t, sfx.CLAIM_FACTS)), F.lit(COMMIT))
    return render.claims(f, sfx.models(f), sfx.behaviours(f)), f, t


@query("a21_claims", SQL_SVC + """
SELECT organization_id, 'api_contract' AS category, 'GET /api' || (c % 10) || '/items' || (k % 100) || '/{key} is handled by ' || module || '.fetch_' || k || '.' AS text FROM svc
UNION ALL SELECT organization_id, 'derived_behavior', module || '.Order' || k || '.save contains 1 conditions, 1 exception paths, 1 state assignments, and 1 side-effect calls in supported extraction.' FROM svc""")
def claims(spark, sf):
    return made_claims(spark, sf)[0].select(ORG, "category", "text")


SQL_VERDICT = SQL_SVC + """
, v AS (SELECT organization_id, 'api_contract' AS category, k FROM svc UNION ALL SELECT organization_id, 'derived_behavior', k FROM svc),
w AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'contradicted' WHEN k % 5 = 1 THEN 'insufficient_evidence' WHEN k % 5 = 2 THEN 'contradicted' WHEN k % 5 = 3 THEN 'insufficient_evidence' ELSE 'supported' END AS verdict,
  CASE k % 5 WHEN 0 THEN 'claim_commit_mismatch' WHEN 1 THEN 'claim_fact_missing' WHEN 2 THEN 'claim_fact_mismatch' WHEN 3 THEN 'claim_evidence_invalid' ELSE '' END AS code FROM v)
"""


def verified(spark, sf):
    """Claims against tampered surroundings: by order key the commit, the fact, its values or the evidence is off."""
    c, f, t = made_claims(spark, sf)
    c = staged(c)  # claimed and current ones are the same rows, made once
    k = lambda col_: F.regexp_extract(col_, r"mod_(\d+)", 1).try_cast("long") % 5
    c = c.withColumn("_k", k("text"))
    facts_now = c.where("_k <> 1").withColumn("expected", F.when(F.col("_k") == 2, F.lit("{}")).otherwise(F.col("expected")))
    ev = staged(sfx.evidence(f.where(F.col("kind").isin("route", "symbol")), t).drop("excerpt"))  # both sides read it; excerpts are cut once
    stored = ev.withColumn("content_hash", F.when(k("path") == 3, F.lit("stale")).otherwise(F.col("content_hash")))
    claimed = c.withColumn("commit_sha", F.when(F.col("_k") == 0, F.lit("other")).otherwise(F.col("commit_sha")))
    return vf.verify_claims(claimed, facts_now, stored, ev, F.lit(COMMIT))


@query("v7_claim_verdicts", SQL_VERDICT + "SELECT organization_id, category, verdict, code, count(*) AS claims FROM w GROUP BY ALL")
def claim_verdicts(spark, sf):
    return verified(spark, sf).groupBy(ORG, "category", "verdict", F.coalesce("code", F.lit("")).alias("code")).agg(F.count(F.lit(1)).alias("claims"))


@query("a22_verdict_counts", SQL_VERDICT + "SELECT organization_id, verdict, count(*) AS claims FROM w GROUP BY ALL")
def verdict_counts(spark, sf):
    return vf.verdict_counts(verified(spark, sf)).drop("repository_id")


def tampered(spark, sf):
    """Generated documents with lost endpoint rows, an unsafe line and a citation beyond the file's end."""
    lines, tree, facts = generated(spark, sf)
    lines = staged(lines)
    lost = (F.col("document_id") == "database_api_reference") & (F.col("section") == 21) & F.col("line").contains("/api3/")
    odd = F.when((F.col("document_id") == "business_logic") & F.col("line").startswith("Handler:"), F.replace("line", F.lit("svc7."), F.lit("<script>svc7."))).when(
        (F.col("document_id") == "business_logic") & F.col("line").startswith("Evidence:"), F.replace("line", F.lit(":L20`"), F.lit(":L20-L99`"))).otherwise(F.col("line"))
    gone = (F.col("document_id") == "kt_handover") & (F.col("line") == "## Practical exercises")
    return lines.where(~lost & ~gone).withColumn("line", odd), lines, tree, facts


@query("v8_section_rules", SQL_SVC + """
SELECT DISTINCT organization_id, 'kt_handover' AS document_id, 'missing' AS problem, 1 AS n FROM svc
UNION ALL SELECT organization_id, 'business_logic', 'unsafe', count(*) FROM svc WHERE c % 20 = 7 GROUP BY ALL""")
def section_rules(spark, sf):
    bad, *_ = tampered(spark, sf)
    n = lambda df, w: df.groupBy(ORG, "document_id").agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit(w))
    return n(vf.missing_sections(bad, runs(spark, sf)), "missing").unionByName(n(vf.unsafe_lines(bad), "unsafe"))


@query("v9_citations", SQL_SVC + """
SELECT organization_id, 'business_logic' AS document_id, path, 20 AS start_line, 99 AS end_line, 1 AS occurrences FROM svc""")
def citations(spark, sf):
    bad, _, tree, _ = tampered(spark, sf)
    return vf.invalid_citations(bad, tree).drop("repository_id")


@query("v6_document_contracts", SQL_SVC + """
, n AS (SELECT organization_id, count(*) AS o, count(*) FILTER (c % 10 = 3) AS lost, count(*) FILTER (c % 20 = 7) AS odd FROM svc GROUP BY ALL)
SELECT organization_id, 'database_api_reference' AS document_id, 2 * o AS expected, 2 * o - lost AS matched, 0 AS unexpected FROM n WHERE lost > 0
UNION ALL SELECT organization_id, 'business_logic', 4 * o + 10 , 4 * o + 10 - o - odd, o + odd FROM n""".replace("4 * o + 10 - o - odd", "3 * o + caps - odd").replace("4 * o + 10 ", "4 * o + caps").replace(
    "FROM svc GROUP BY ALL)\nSELECT", ", count(DISTINCT c % 10) AS caps FROM svc GROUP BY ALL)\nSELECT"))
def document_contracts(spark, sf):
    bad, good, *_ = tampered(spark, sf)
    facts_only = lambda df: df.where(F.col("section") % 10 != 0)
    return vf.contract_metrics(facts_only(good), facts_only(bad), [ORG, "document_id"]).where(F.col("status") != "complete").select(
        ORG, "document_id", "expected", "matched", "unexpected")


@query("v10_correction", SQL_SVC + """
, d AS (SELECT unnest(['system_overview', 'business_logic', 'database_api_reference', 'developer_operations', 'kt_handover']) AS document_id)
SELECT DISTINCT organization_id, document_id, CASE WHEN document_id IN ('business_logic', 'database_api_reference', 'kt_handover') THEN 2 ELSE 1 END AS version, 'checks_passed' AS verification_status FROM svc, d""")
def correction(spark, sf):
    bad, good, tree, facts = tampered(spark, sf)
    _, versions, open_ = vf.correct_documents(bad, good, runs(spark, sf), tree)
    cov = sfx.structural_coverage(tree, facts)
    return vf.document_status(versions, open_, cov).drop("repository_id")


@query("a23_coverage_metric", """
SELECT p_brand, count(*) FILTER (p_size > 25) AS detected, count(*) FILTER (p_size > 40) AS documented,
  coalesce(round(count(*) FILTER (p_size > 40) / nullif(count(*) FILTER (p_size > 25), 0), 4), -1) AS ratio,
  CASE WHEN count(*) FILTER (p_size > 25) = 0 THEN 'not_applicable' WHEN count(*) FILTER (p_size > 25) = count(*) FILTER (p_size > 40) THEN 'complete' ELSE 'incomplete' END AS status FROM part GROUP BY p_brand""")
def coverage_metric(spark, sf):
    p = wh.table(spark, sf, "part").groupBy("p_brand").agg(F.count_if(F.col("p_size") > 25).alias("detected"), F.count_if(F.col("p_size") > 40).alias("documented"))
    return vf.with_coverage_status(p).withColumn("ratio", F.coalesce("ratio", F.lit(-1.0)))


def run_summary(spark, sf):
    o = wh.table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        F.col("o_orderpriority").alias(ORG), k.cast("string").alias("repository_id"), F.when(c % 2 == 0, F.sha1(k.cast("string"))).otherwise("abc").alias("commit_sha"),
        (c % 3).alias("included_files"), F.when(k % 2 == 0, "complete").otherwise("partial").alias("coverage_status"), F.lit(5).alias("documents_present"), F.lit(0).alias("documents_incomplete"),
        F.when(k % 3 == 0, "needs_review").otherwise("checks_passed").alias("verification_status"), F.lit(4).alias("claims"), (F.lit(4) - k % 2).alias("supported_claims"),
        F.lit(9).alias("contracts"), F.lit(0).alias("incomplete_contracts"), F.lit(0).alias("invalid_citations"), F.lit(0).alias("blocking_findings"))


@query("a24_acceptance", """
WITH r AS (SELECT o_orderpriority AS organization_id, o_orderkey::VARCHAR AS repository_id, (o_custkey % 2 <> 0)::INT + (o_custkey % 3 = 0)::INT + (o_orderkey % 2 <> 0)::INT AS failed,
   (o_orderkey % 2 <> 0)::INT + (o_orderkey % 3 = 0)::INT AS review FROM orders)
SELECT organization_id, repository_id, 10 AS total_checks, 10 - failed - review AS passed, review, failed, round((10 - failed - review) / 10 * 100, 1) AS score_percent,
  CASE WHEN failed > 0 THEN 'not_ready' WHEN review > 0 THEN 'needs_review' ELSE 'ready' END AS overall_status FROM r""")
def acceptance(spark, sf):
    return vf.acceptance_report(vf.acceptance_checks(run_summary(spark, sf)))


@query("source_analysis", SQL_SVC + """
SELECT DISTINCT organization_id, 10 AS total_checks, 10 AS passed, 100.0 AS score_percent, 'ready' AS overall_status FROM svc""")
def source_analysis(spark, sf):
    tree = dc.service_tree(spark, sf)
    sha = "a" * 40
    run = runs(spark, sf).withColumn("commit_sha", F.lit(sha))
    report, _ = analysis.accept(analysis.stored(analysis.analyze(tree, run, sha)), tree, run, sha)
    return report.select(ORG, "total_checks", "passed", "score_percent", "overall_status")


def tree_changed_later(spark, sf):
    """The services as someone left them after the analysis: even ones have their handler renamed, odd ones another message."""
    t = dc.service_tree(spark, sf)
    key = F.regexp_extract("path", r"mod_(\d+)\.py$", 1)
    text = F.when((key != "") & (F.try_to_number(key, F.lit("999999999999")) % 2 == 0), F.replace("text", F.lit("fetch_"), F.lit("get_"))).otherwise(F.replace("text", F.lit("too big"), F.lit("too much")))
    return t.withColumn("text", text)


@query("source_analysis_tampered", SQL_SVC + """
SELECT DISTINCT organization_id, 10 AS total_checks, 8 AS passed, 80.0 AS score_percent, 'not_ready' AS overall_status FROM svc""")
def source_analysis_tampered(spark, sf):
    sha = "a" * 40
    run = runs(spark, sf).withColumn("commit_sha", F.lit(sha))
    found = analysis.stored(analysis.analyze(dc.service_tree(spark, sf), run, sha))
    report, _ = analysis.accept(found, tree_changed_later(spark, sf), run, sha)
    return report.select(ORG, "total_checks", "passed", "score_percent", "overall_status")


@query("source_analysis_stale_claims", SQL_SVC + """
SELECT organization_id, 'api_contract' AS category, CASE WHEN k % 2 = 0 THEN 'insufficient_evidence' ELSE 'supported' END AS verdict,
  CASE WHEN k % 2 = 0 THEN 'claim_fact_missing' ELSE '' END AS code, count(*) AS claims FROM svc GROUP BY ALL
UNION ALL SELECT organization_id, 'derived_behavior', CASE WHEN k % 2 = 0 THEN 'supported' ELSE 'insufficient_evidence' END, CASE WHEN k % 2 = 0 THEN '' ELSE 'claim_evidence_invalid' END, count(*) FROM svc GROUP BY ALL""")
def stale_claims(spark, sf):
    sha = "a" * 40
    run = runs(spark, sf).withColumn("commit_sha", F.lit(sha))
    found, later = analysis.stored(analysis.analyze(dc.service_tree(spark, sf), run, sha)), tree_changed_later(spark, sf)
    rows = analysis.claim_verdicts(found, analysis.analyze(later, run, sha), later, sha)
    return rows.groupBy(ORG, "category", "verdict", F.coalesce("code", F.lit("")).alias("code")).agg(F.count(F.lit(1)).alias("claims"))
