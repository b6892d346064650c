"""Generated documents as tables of lines: (tenant, repository, document_id, section, key, seq, line).

A document is never gathered while it is made or checked; ordering by (section, key, seq) writes it out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import col, table_cell
from .source_facts import REPO

# Document titles, table heads and texts that checks look for.
DOCUMENTS = {
    "system_overview": "System Overview & Architecture", "business_logic": "Functional & Business Logic",
    "database_api_reference": "Database & API Reference", "developer_operations": "Developer & Operations Guide",
    "kt_handover": "KT Plan & Handover Guide",
}
COMPONENT_HEAD = "| Component | Files | Languages | Symbols | Routes | Models |"
ENTRY_HEAD = "| Kind | Target | Framework | Source |"
DEPENDENCY_HEAD = "| Package | Version | Scope | Manifest |"
CAPABILITY_HEAD = "| Capability group | Routes | Methods |"
BEHAVIOUR_HEAD = "| Function or method | Conditions | Errors | State changes | Side effects | Source |"
FIELD_HEAD = "| Field | Type | Required | Default/declaration |"
ENDPOINT_HEAD = "| Method | Path | Handler | Framework | Confidence | Source |"
ERROR_HEAD = "| Handler | Raised expression | Source line |"
CONFIG_HEAD = "| Key | Access mechanism | Source |"
LANGUAGE_HEAD = "| Runtime/language | Source files |"
COMMAND_HEAD = "| Kind | Target | Command | Source |"
SESSIONS = (
    ("1", "45 min", "Purpose, repository map, and architecture", "Participant can explain component boundaries"),
    ("2", "60 min", "Entry points and request workflows", "Trace one request from entry point to side effects"),
    ("3", "60 min", "Data models, persistence, and configuration", "Explain one model and its configuration dependencies"),
    ("4", "45 min", "Testing, deployment, and operations", "Runbook gaps and operational prerequisites recorded"),
    ("5", "45 min", "Hands-on change and handover review", "Small change reviewed and ownership questions captured"),
)
LINE_COLUMNS = [*REPO, "document_id", "section", "key", "seq", "line"]


def source_ref(path, line, evidence_id=None) -> Column:
    at = F.concat(F.lit("`"), col(path), F.lit(":L"), col(line).cast("string"), F.lit("`"))
    return at if evidence_id is None else F.concat(at, F.coalesce(F.concat(F.lit(" (`"), col(evidence_id), F.lit("`)")), F.lit("")))


def quoted(c) -> Column:
    return F.concat(F.lit("`"), table_cell(c), F.lit("`"))


def table_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("—")) for c in cells]), F.lit(" |"))


def endpoint_row() -> Column:
    return table_row(F.concat(F.lit("**"), table_cell("method"), F.lit("**")), quoted("route_path"), quoted("handler"), table_cell("framework"),
                     table_cell("confidence"), source_ref("path", "line", "evidence_id"))


def field_row() -> Column:
    flag = F.get_json_object("required_default", "$[0]")
    required = F.when(flag == "true", "yes").when(flag == "false", "no").otherwise("unknown")
    return table_row(quoted("name"), quoted("type"), required, quoted(F.get_json_object("required_default", "$[1]")))


def error_row() -> Column:
    return table_row(quoted("owner"), quoted("name"), source_ref("path", "line"))


def behaviour_row() -> Column:
    return table_row(quoted("qualified_name"), F.col("conditions"), F.col("exceptions"), F.col("state_changes"), F.col("side_effects"),
                     source_ref("path", "start_line"))


def component_row() -> Column:
    return table_row(quoted("component"), F.col("file_count"), F.coalesce(F.nullif(F.array_join(F.map_keys("languages"), ", "), F.lit("")), F.lit("Unknown")),
                     F.col("symbol_count"), F.col("route_count"), F.col("model_count"))


def entry_row() -> Column:
    return table_row(table_cell("entry_kind"), quoted("target"), table_cell("framework"), source_ref("path", "line", "evidence_id"))


def dependency_row() -> Column:
    return table_row(quoted("name"), quoted("version"), table_cell("scope"), quoted("path"))


def config_row() -> Column:
    return table_row(quoted("name"), quoted("owner"), source_ref("path", "line"))


def routes_of(facts: DataFrame) -> DataFrame:
    kind = F.split("extra", r"\|")
    return facts.where(F.col("kind") == "route").select(
        *REPO, "path", "fact_id", "evidence_id", "commit_sha", "line", F.col("name").alias("method"), F.col("value").alias("route_path"),
        F.col("owner").alias("handler"), kind[0].alias("framework"), kind[1].alias("confidence"))


def entries_of(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("kind") == "entry_point").select(
        *REPO, "path", "fact_id", "evidence_id", "commit_sha", "line", F.col("owner").alias("entry_kind"), F.col("name").alias("target"), F.col("value").alias("framework"))


def route_capabilities(routes: DataFrame) -> DataFrame:
    """Routes grouped by the first fixed path segment: count and sorted distinct methods."""
    segs = F.filter(F.split(F.coalesce("route_path", F.lit("dynamic")), "/"), lambda s: (s != "") & ~s.startswith("{") & ~s.startswith(":"))
    r = routes.withColumn("capability", F.coalesce(F.get(segs, F.lit(0)), F.lit("root")))
    return r.groupBy(*REPO, "capability").agg(F.count(F.lit(1)).alias("route_count"), F.array_sort(F.collect_set(F.coalesce("method", F.lit("ANY")))).alias("methods"))


def language_totals(components: DataFrame) -> DataFrame:
    return components.select(*REPO, F.explode("languages").alias("language", "n")).groupBy(*REPO, "language").agg(F.sum("n").alias("files"))


def distinct_config(facts: DataFrame) -> DataFrame:
    """Each (key, file, line) once."""
    c = facts.where(F.col("kind") == "config")
    return c.groupBy(*REPO, "name", "path", "line").agg(F.min("owner").alias("owner"))


def _lines(df: DataFrame, document: str, section: int, line: Column, key: Column | None = None, seq: Column | None = None) -> DataFrame:
    """One line per row; the key orders rows inside the section."""
    return df.select(*REPO, F.lit(document).alias("document_id"), F.lit(section).alias("section"), (key if key is not None else line).alias("key"),
                     (seq if seq is not None else F.lit(0)).cast("long").alias("seq"), line.alias("line"))


def _fixed(runs: DataFrame, document: str, section: int, *texts) -> DataFrame:
    """Constant or per-run lines; they open the section they stand in."""
    made = F.array(*[t if isinstance(t, Column) else F.lit(t) for t in texts])
    return runs.select(*REPO, F.lit(document).alias("document_id"), F.lit(section).alias("section"), F.lit("").alias("key"), F.posexplode(made).alias("seq", "line")).withColumn(
        "seq", F.col("seq").cast("long")).select(LINE_COLUMNS)


def _table_head(runs, document, section, heading, head):
    rule = "|" + "---|" * (head.count("|") - 1)
    return _fixed(runs, document, section, f"## {heading}", "", head, rule)


def render_documents(runs: DataFrame, facts: DataFrame, components: DataFrame, interactions: DataFrame, dependencies: DataFrame,
                     models: DataFrame, behaviours: DataFrame, other_behaviours: DataFrame) -> DataFrame:
    """All five documents of all runs.  ``runs``: (tenant, repository, repository_name, commit_sha)."""
    routes, entries, config = routes_of(facts), entries_of(facts), distinct_config(facts)
    so, bl, db, ops, kt = DOCUMENTS
    parts = []
    for doc, title in DOCUMENTS.items():
        parts.append(_fixed(runs, doc, 0, f"# {title}", "", F.format_string("**Repository:** `%s`  ", "repository_name"),
                            F.format_string("**Commit:** `%s`  ", "commit_sha"), ""))
    parts += [
        _fixed(runs, so, 10, "## Project purpose", "", F.format_string("**Inference:** `%s` was read from its pinned source.", "repository_name"), ""),
        _table_head(runs, so, 20, "Components", COMPONENT_HEAD), _lines(components, so, 21, component_row()),
        _fixed(runs, so, 30, "", "## Component interaction diagram", "", "```mermaid", "flowchart LR"),
        _lines(components, so, 31, F.format_string('  c_%s["%s"]', F.left(F.md5("component"), F.lit(8)), F.regexp_replace("component", "[^A-Za-z0-9_./ -]", ""))),
        _lines(interactions, so, 32, F.format_string("  c_%s -->|imports ×%d| c_%s", F.left(F.md5("source"), F.lit(8)), "evidence_count", F.left(F.md5("target"), F.lit(8)))),
        _fixed(runs, so, 33, "```", ""),
        _table_head(runs, so, 40, "Entry points", ENTRY_HEAD), _lines(entries, so, 41, entry_row()),
        _table_head(runs, so, 50, "External dependencies", DEPENDENCY_HEAD), _lines(dependencies, so, 51, dependency_row()),
        _table_head(runs, bl, 10, "Detected capabilities", CAPABILITY_HEAD),
        _lines(route_capabilities(routes), bl, 11, table_row(quoted("capability"), F.col("route_count"), F.array_join("methods", ", "))),
        _fixed(runs, bl, 20, "", "## Request workflows", ""),
    ]
    title = F.format_string("### `%s %s`", "method", F.coalesce("route_path", F.lit("dynamic path")))
    place = F.concat_ws(":", "path", F.lpad(F.col("line").cast("string"), 8, "0"), "method", "route_path")
    parts += [
        _lines(routes, bl, 21, title, place, F.lit(0)),
        _lines(routes, bl, 21, F.format_string("Handler: `%s`  ", F.coalesce("handler", F.lit("inline/unknown"))), place, F.lit(1)),
        _lines(routes, bl, 21, F.concat(F.lit("Evidence: "), source_ref("path", "line", "evidence_id")), place, F.lit(2)),
        _table_head(runs, bl, 30, "Additional implementation behavior", BEHAVIOUR_HEAD), _lines(other_behaviours, bl, 31, behaviour_row()),
        _fixed(runs, db, 10, "## Data models", ""),
    ]
    m_place = F.concat_ws(":", "path", "qualified_name")
    m_meta = F.concat(F.format_string("Kind: `%s`", "model_kind"), F.when(F.col("table_name").isNotNull(), F.format_string(" · Table: `%s`", "table_name")).otherwise(""), F.lit(" · Source: "), source_ref("path", "line"))
    fields = facts.where(F.col("kind") == "field").select(*REPO, "path", F.col("owner").alias("qualified_name"), "name", F.col("value").alias("type"), F.col("extra").alias("required_default"), "line")
    parts += [
        _lines(models, db, 11, F.format_string("### `%s`", "qualified_name"), m_place, F.lit(0)), _lines(models, db, 11, m_meta, m_place, F.lit(1)),
        _lines(models, db, 11, F.lit(FIELD_HEAD), m_place, F.lit(2)), _lines(models, db, 11, F.lit("|---|---|---|---|"), m_place, F.lit(3)),
        _lines(fields, db, 11, field_row(), m_place, F.col("line") + 10),
        _table_head(runs, db, 20, "API endpoints", ENDPOINT_HEAD), _lines(routes, db, 21, endpoint_row()),
        _table_head(runs, db, 30, "Error handling evidence", ERROR_HEAD), _lines(facts.where(F.col("kind") == "exception"), db, 31, error_row()),
        _table_head(runs, ops, 10, "Detected prerequisites", LANGUAGE_HEAD), _lines(language_totals(components), ops, 11, table_row(table_cell("language"), F.col("files"))),
        _table_head(runs, ops, 20, "Configuration", CONFIG_HEAD), _lines(config, ops, 21, config_row()),
        _table_head(runs, ops, 30, "Startup and build commands", COMMAND_HEAD), _fixed(runs, ops, 40, "", "## Tests", ""),
        _fixed(runs, kt, 10, "## Prerequisite knowledge", "", "- Familiarity with source-level API and data-model contracts.", ""),
        _fixed(runs, kt, 20, "## Recommended session sequence", "", "| Session | Recommended duration | Focus | Checkpoint |", "|---|---|---|---|",
               *["| " + " | ".join(s) + " |" for s in SESSIONS], ""),
        _fixed(runs, kt, 30, "## Practical exercises", "", "1. Locate one route or entry point and identify its handler, conditions, error paths, and side effects.", ""),
        _fixed(runs, kt, 40, "## Handover checkpoints", "", "- Component responsibilities and dependencies have named owners.", ""),
    ]
    return reduce(DataFrame.unionByName, [p.select(LINE_COLUMNS) for p in parts])


def claims(facts: DataFrame, models: DataFrame, behaviours: DataFrame) -> DataFrame:
    """Claims about routes, models, entry points and behaviours with the values each expects.

    The claim id follows from the fact, so no global numbering is needed.
    """
    r, e = routes_of(facts), entries_of(facts)
    ids = facts.select(*REPO, "path", F.col("owner").alias("qualified_name"), "kind", "fact_id", "evidence_id", "commit_sha")
    m = models.join(ids.where(F.col("kind") == "model").drop("kind"), [*REPO, "path", "qualified_name"])
    b = behaviours.join(ids.where(F.col("kind") == "symbol").drop("kind"), [*REPO, "path", "qualified_name"])

    def made(df, document, category, criticality, text, expected):
        return df.select(*REPO, F.concat(F.lit("claim-"), F.left(F.sha2(F.concat_ws(":", F.lit(category), "fact_id"), 256), F.lit(16))).alias("claim_id"),
                         F.lit(document).alias("document_type"), F.lit(category).alias("category"), F.lit(criticality).alias("criticality"), text.alias("text"),
                         "fact_id", "evidence_id", "commit_sha", expected.alias("expected"))

    j = lambda *cols: F.to_json(F.struct(*cols))
    return (
        made(r, "database_api_reference", "api_contract", "high", F.format_string("%s %s is handled by %s.", "method", "route_path", "handler"), j("method", "route_path", "handler", "path", "line"))
        .unionByName(made(m, "database_api_reference", "data_contract", "high", F.format_string("%s is a detected %s model with %d extracted fields.", "qualified_name", "model_kind", "field_count"),
                          j("qualified_name", "model_kind", "field_count", "path", "line")))
        .unionByName(made(e, "system_overview", "architecture", "medium", F.format_string("%s is a detected %s entry point.", "target", "entry_kind"), j("target", "entry_kind", "framework", "path", "line")))
        .unionByName(made(b, "business_logic", "derived_behavior", "high", F.format_string(
            "%s contains %d conditions, %d exception paths, %d state assignments, and %d side-effect calls in supported extraction.",
            "qualified_name", "conditions", "exceptions", "state_changes", "side_effects"), j("qualified_name", "conditions", "exceptions", "state_changes", "side_effects", "path", "start_line")))
    )
