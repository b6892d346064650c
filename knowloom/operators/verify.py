"""Verification of generated documents and claims: multisets, contracts, evidence, citations, acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import col, line_count, lines as lines_of, strip
from . import render
from .retrieval import top_k
from .source_facts import REPO

# Severities, required sections, patterns.
BLOCKING = ("critical", "high")
REQUIRED_SECTIONS = {
    "system_overview": ("## Project purpose", "## Components", "## Entry points", "## External dependencies"),
    "business_logic": ("## Detected capabilities", "## Request workflows", "## Additional implementation behavior"),
    "database_api_reference": ("## Data models", "## API endpoints", "## Error handling evidence"),
    "developer_operations": ("## Detected prerequisites", "## Configuration", "## Startup and build commands", "## Tests"),
    "kt_handover": ("## Prerequisite knowledge", "## Recommended session sequence", "## Practical exercises", "## Handover checkpoints"),
}
UNSAFE = r"(?i)<\s*(script|iframe|object|embed)\b|javascript\s*:"
CITATION = r"`([^`\r\n]+):L(\d+)(?:-L(\d+))?`"
FULL_COMMIT = r"^[0-9a-fA-F]{40,64}$"
CORRECTION_ROUNDS = 2


# ------------------------------------------------------------------ multisets


def multiset_difference(expected: DataFrame, actual: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(missing, unexpected), repeats counted."""
    return expected.exceptAll(actual), actual.exceptAll(expected)


def contract_metrics(expected: DataFrame, actual: DataFrame, keys: list[str], row: str = "line") -> DataFrame:
    """Per key: expected, matched and unexpected row counts of two multisets, and whether they agree.

    Equal rows are counted together on both sides in one aggregation, so a row that occurs very often
    is one combined count before anything moves.
    """
    both = expected.select(*keys, row, F.lit(1).alias("_e"), F.lit(0).alias("_a")).unionByName(
        actual.select(*keys, row, F.lit(0).alias("_e"), F.lit(1).alias("_a")))
    counted = both.groupBy(*keys, row).agg(F.sum("_e").alias("_e"), F.sum("_a").alias("_a"))
    out = counted.groupBy(*keys).agg(
        F.sum("_e").alias("expected"), F.sum(F.least("_e", "_a")).alias("matched"),
        F.sum(F.greatest(F.col("_a") - F.col("_e"), F.lit(0))).alias("unexpected"), F.sum(F.greatest(F.col("_e") - F.col("_a"), F.lit(0))).alias("missing"))
    return out.withColumn("status", F.when((F.col("missing") == 0) & (F.col("unexpected") == 0), "complete").otherwise("mismatch"))


def contract_examples(expected: DataFrame, actual: DataFrame, keys: list[str], row: str = "line", limit: int = 10) -> DataFrame:
    """Up to ten missing and ten unexpected rows per key, in row order."""
    missing, extra = multiset_difference(expected.select(*keys, row), actual.select(*keys, row))
    both = missing.withColumn("kind", F.lit("missing")).unionByName(extra.withColumn("kind", F.lit("unexpected")))
    return top_k(both, [*keys, "kind"], [F.asc(row)], limit, "position")


# ------------------------------------------------------------------ Markdown texts


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def section_of(markdown, heading, stop_level: int = 2) -> Column:
    """Body of an exact heading line up to the next heading of the same or a higher level; empty when absent."""
    stop = rf"^#{{1,{stop_level}}}\s"
    at = lambda ls: F.array_position(ls, col(heading))
    tail = bind(lines_of(markdown), lambda ls: F.when(at(ls) > 0, F.slice(ls, (at(ls) + 1).cast("int"), F.size(ls))))
    body = bind(tail, lambda t: bind(F.array_position(F.transform(t, lambda l: l.rlike(stop)), F.lit(True)), lambda end: F.when(
        end > 0, F.slice(t, F.lit(1), (end - 1).cast("int"))).otherwise(t)))
    return F.coalesce(F.array_join(body, "\n"), F.lit(""))


def table_rows_of(section, head) -> Column:
    """Data rows of the table with this exact head: the run of ``|`` lines after its rule line."""
    first = lambda ls, test: F.array_position(F.transform(ls, test), F.lit(True))
    at = lambda ls: F.array_position(ls, col(head))
    tail = bind(lines_of(section), lambda ls: F.when(at(ls) > 0, F.slice(ls, (at(ls) + 2).cast("int"), F.size(ls))))
    run = bind(tail, lambda t: bind(first(t, lambda l: strip(l) != ""), lambda n: F.when(n > 0, F.slice(t, n.cast("int"), F.size(t)))))
    rows = bind(run, lambda r: bind(first(r, lambda l: ~l.startswith("|")), lambda n: F.when(n > 0, F.slice(r, F.lit(1), (n - 1).cast("int"))).otherwise(r)))
    return F.coalesce(rows, F.array().cast("array<string>"))


def documents_as_text(document_lines: DataFrame) -> DataFrame:
    """Lines written out per document, for sinks and readers that need whole texts."""
    packed = F.array_sort(F.collect_list(F.struct("section", "key", "seq", "line")))
    return document_lines.groupBy(*REPO, "document_id").agg(F.concat(F.array_join(F.transform(packed, lambda l: l["line"]), "\n"), F.lit("\n")).alias("markdown"))


# ------------------------------------------------------------------ claims


def verify_claims(claims: DataFrame, facts_now: DataFrame, evidence: DataFrame, sources: DataFrame, commit: Column) -> DataFrame:
    """Verdict per claim: commit, then fact, then expected values, then evidence read again from the source.

    ``facts_now``: current claims' facts (fact_id, expected).  ``evidence``: records as stored.
    ``sources``: the same records read again from the files.
    """
    f = facts_now.select(*REPO, "fact_id", F.col("expected").alias("_now")).dropDuplicates([*REPO, "fact_id"])
    e = evidence.select(*REPO, "evidence_id", F.col("content_hash").alias("_stored"), F.col("commit_sha").alias("_commit")).dropDuplicates([*REPO, "evidence_id"])
    s = sources.select(*REPO, "evidence_id", F.col("content_hash").alias("_read")).dropDuplicates([*REPO, "evidence_id"])
    rows = claims.join(f, [*REPO, "fact_id"], "left").join(e, [*REPO, "evidence_id"], "left").join(s, [*REPO, "evidence_id"], "left")
    no = lambda c: F.coalesce(~c, F.lit(True))
    verdict = (
        F.when(no(F.col("commit_sha") == commit), "contradicted").when(F.col("_now").isNull(), "insufficient_evidence")
        .when(no(F.col("_now") == F.col("expected")), "contradicted").when(F.col("_stored").isNull(), "insufficient_evidence")
        .when(no(F.col("_commit") == commit) | no(F.col("_stored") == F.col("_read")), "insufficient_evidence").otherwise("supported"))
    code = (
        F.when(no(F.col("commit_sha") == commit), "claim_commit_mismatch").when(F.col("_now").isNull(), "claim_fact_missing")
        .when(no(F.col("_now") == F.col("expected")), "claim_fact_mismatch").when(verdict != "supported", "claim_evidence_invalid"))
    severity = F.when(code == "claim_commit_mismatch", "critical").when(code.isNotNull(), "high")
    return rows.withColumns({"verdict": verdict, "code": code, "severity": severity}).drop("_now", "_stored", "_commit", "_read")


# ------------------------------------------------------------------ document checks


def missing_sections(document_lines: DataFrame, runs: DataFrame) -> DataFrame:
    """Required headings that a document lacks; only lines that are one of them are moved."""
    rules = F.array(*[F.struct(F.lit(d).alias("document_id"), F.lit(s).alias("line")) for d, ss in REQUIRED_SECTIONS.items() for s in ss])
    wanted = runs.select(*REPO, F.explode(rules).alias("_r")).select(*REPO, "_r.*")
    headings = document_lines.where(F.col("line").isin([s for ss in REQUIRED_SECTIONS.values() for s in ss]))
    return wanted.join(headings.select(*REPO, "document_id", "line").distinct(), [*REPO, "document_id", "line"], "left_anti")


def wrong_headers(document_lines: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents that do not name their repository or commit."""
    need = F.array(
        F.struct(F.lit("document_repository_mismatch").alias("code"), F.format_string("**Repository:** `%s`", "repository_name").alias("_t")),
        F.struct(F.lit("document_commit_mismatch").alias("code"), F.format_string("**Commit:** `%s`", "commit_sha").alias("_t")))
    docs = F.array(*map(F.lit, render.DOCUMENTS))
    wanted = runs.select(*REPO, F.explode(docs).alias("document_id"), need.alias("_n")).select(*REPO, "document_id", F.explode("_n").alias("_x")).select(*REPO, "document_id", "_x.*")
    said = document_lines.where(F.col("line").startswith("**")).select(*REPO, "document_id", F.trim("line").alias("_t")).distinct()
    return wanted.join(said, [*REPO, "document_id", "_t"], "left_anti").drop("_t")


def unsafe_lines(document_lines: DataFrame) -> DataFrame:
    return document_lines.where(F.col("line").rlike(UNSAFE)).select(*REPO, "document_id", "line")


def line_counts(files: DataFrame) -> DataFrame:
    return files.select(*REPO, "path", line_count("text").alias("line_count"))


def invalid_citations(document_lines: DataFrame, files: DataFrame) -> DataFrame:
    """Citations whose file is unknown or whose range is not inside it, with how often each occurs."""
    # A line is searched once; within a citation the last ``:L`` ends the path.
    whole = F.explode(F.regexp_extract_all("line", F.lit(CITATION), F.lit(0)))
    c = document_lines.where(F.col("line").contains(":L")).select(*REPO, "document_id", whole.alias("_c")).withColumn("_at", F.rtrim(F.substring_index("_c", ":L", -1), F.lit("`"))).select(
        *REPO, "document_id", F.substring("_c", F.lit(2), F.length("_c") - F.length("_at") - 4).alias("path"),
        F.substring_index("_at", "-L", 1).cast("int").alias("start_line"), F.substring_index("_at", "-L", -1).cast("int").alias("end_line"))
    c = c.groupBy(*REPO, "document_id", "path", "start_line", "end_line").agg(F.count(F.lit(1)).alias("occurrences"))
    bad = F.col("line_count").isNull() | (F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")) | (F.col("end_line") > F.col("line_count"))
    return c.join(line_counts(files), [*REPO, "path"], "left").where(bad).drop("line_count")


def findings(document_lines: DataFrame, expected_lines: DataFrame, runs: DataFrame, files: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(tenant, repository, document_id, code, severity, fixable, count) over all document checks, of the documents in ``only`` where it is given."""
    keys = [*REPO, "document_id"]
    asked = lambda df: df if only is None else df.join(only, keys, "left_semi")

    def of(df: DataFrame, code: Column, severity: str) -> DataFrame:
        return df.withColumn("code", code).groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("count")).withColumns({"severity": F.lit(severity), "fixable": F.lit(True)})

    facts_only = lambda df: df.where(F.col("section") % 10 != 0)
    metric = contract_metrics(facts_only(expected_lines), facts_only(document_lines), keys).where(F.col("status") != "complete")
    return (
        of(asked(missing_sections(document_lines, runs)), F.lit("required_sections_missing"), "high")
        .unionByName(of(asked(wrong_headers(document_lines, runs)), F.col("code"), "critical"))
        .unionByName(of(unsafe_lines(document_lines), F.lit("unsafe_markdown_content"), "critical"))
        .unionByName(of(invalid_citations(document_lines, files), F.lit("invalid_source_citation"), "high"))
        .unionByName(of(metric, F.lit("document_contract_mismatch"), "high"))
    )


def correct_documents(document_lines: DataFrame, expected_lines: DataFrame, runs: DataFrame, files: DataFrame, rounds: int = CORRECTION_ROUNDS, save=None):
    """Replace documents with fixable findings by fresh ones, at most ``rounds`` times.

    Returns (lines, versions, findings).  ``save`` keeps findings and the names of broken documents between rounds (written
    tables by default); lines are not written again, and a round checks the documents that it replaced.
    """
    from ..session import staged

    save = save or staged
    keys = [*REPO, "document_id"]
    versions = runs.select(*REPO, F.explode(F.array(*map(F.lit, render.DOCUMENTS))).alias("document_id"), F.lit(1).alias("version"))
    current, open_ = document_lines, save(findings(document_lines, expected_lines, runs, files))  # read here and by callers
    for _ in range(rounds):
        broken = save(open_.where("fixable").select(*keys).distinct())
        if broken.isEmpty():
            break
        fresh = expected_lines.join(broken, keys, "left_semi")
        current = current.join(broken, keys, "left_anti").unionByName(fresh)
        hit = broken.withColumn("_b", F.lit(1))
        versions = versions.join(hit, keys, "left").select(*keys, (F.col("version") + F.coalesce("_b", F.lit(0))).alias("version"))
        open_ = save(open_.join(broken, keys, "left_anti").unionByName(findings(fresh, fresh, runs, files, broken)))
    return current, versions, open_


def document_status(versions: DataFrame, open_findings: DataFrame, partial: DataFrame) -> DataFrame:
    """needs_review where a blocking finding is open or the structural scope is partial, else checks_passed."""
    keys = [*REPO, "document_id"]
    b = open_findings.groupBy(*keys).agg(F.bool_or(F.col("severity").isin(*BLOCKING)).alias("_block"))
    p = partial.select(*REPO, (F.col("status") != "complete").alias("_partial"))
    bad = F.coalesce("_block", F.lit(False)) | F.coalesce("_partial", F.lit(False))
    return versions.join(b, keys, "left").join(p, REPO, "left").select(*keys, "version", F.when(bad, "needs_review").otherwise("checks_passed").alias("verification_status"))


# ------------------------------------------------------------------ metrics and acceptance


def coverage_metric(df: DataFrame, keys: list[str], present: Column) -> DataFrame:
    """detected, documented, ratio (four places; null when nothing was detected) and status."""
    c = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("detected"), F.count_if(present).alias("documented"))
    return with_coverage_status(c)


def with_coverage_status(c: DataFrame) -> DataFrame:
    ratio = F.when(F.col("detected") > 0, F.round(F.col("documented") / F.col("detected"), 4))
    status = F.when(F.col("detected") == 0, "not_applicable").when(F.col("detected") == F.col("documented"), "complete").otherwise("incomplete")
    return c.withColumns({"ratio": ratio, "status": status})


def verdict_counts(verified: DataFrame) -> DataFrame:
    return verified.groupBy(*REPO, "verdict").agg(F.count(F.lit(1)).alias("claims"))


def findings_by_severity(found: DataFrame) -> DataFrame:
    return found.groupBy(*REPO, "severity").agg(F.sum("count").alias("findings"))


def acceptance_checks(summary: DataFrame) -> DataFrame:
    """Ten checks per run from one summary row: (tenant, repository, position, id, status).

    Summary columns: commit_sha, included_files, coverage_status, documents_present, documents_incomplete,
    verification_status, claims, supported_claims, contracts, incomplete_contracts, invalid_citations, blocking_findings.
    """
    c = F.col
    fail = lambda ok: F.when(ok, "pass").otherwise("fail")
    checks = [
        ("pinned_commit", fail(F.coalesce(c("commit_sha"), F.lit("")).rlike(FULL_COMMIT))), ("source_inventory", fail(c("included_files") > 0)),
        ("structural_coverage", F.when(c("coverage_status") == "complete", "pass").otherwise("review")),
        ("five_documents", fail((c("documents_present") >= len(render.DOCUMENTS)) & (c("documents_incomplete") == 0))),
        ("document_verification", F.when(c("verification_status") == "checks_passed", "pass").when(c("verification_status") == "verification_incomplete", "fail").otherwise("review")),
        ("claim_grounding", fail(c("claims") == c("supported_claims"))), ("exact_document_contracts", fail((c("contracts") > 0) & (c("incomplete_contracts") == 0))),
        ("source_citations", fail(c("invalid_citations") == 0)), ("blocking_findings", fail(c("blocking_findings") == 0)), ("source_only_execution", F.lit("pass")),
    ]
    rows = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(n).alias("id"), s.alias("status")) for i, (n, s) in enumerate(checks)])
    return summary.select(*REPO, F.explode(rows).alias("_c")).select(*REPO, "_c.*")


def acceptance_report(checks: DataFrame) -> DataFrame:
    """Totals, score and overall status per run."""
    n = lambda s: F.count_if(F.col("status") == s)
    r = checks.groupBy(*REPO).agg(F.count(F.lit(1)).alias("total_checks"), n("pass").alias("passed"), n("review").alias("review"), n("fail").alias("failed"))
    return r.withColumns({
        "score_percent": F.round(F.col("passed") / F.col("total_checks") * 100, 1),
        "overall_status": F.when(F.col("failed") > 0, "not_ready").when(F.col("review") > 0, "needs_review").otherwise("ready")})
