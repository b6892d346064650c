"""Ownership, coverage, health scores, gaps, questions and onboarding packs for all modules at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import paths
from ..functions.text import emails, file_mentions
from .retrieval import top_k

ORG = "organization_id"
MODULE = [ORG, "module_id"]

# Weights, thresholds and caps.
DOC_WEIGHT, OWNERSHIP_WEIGHT = 0.40, 0.60
COVERAGE_WARNING, BUS_FACTOR_TARGET = 80.0, 3
TOP_OWNERS, SIGNAL_CAP, QUESTION_CAP = 10, 15, 8
COMPLEX_TOKENS, LOW_COVERAGE = 200, 50.0
KNOWN_MANIFESTS = (
    "requirements.txt", "package.json", "pyproject.toml", "pipfile", "environment.yml", "setup.py", "readme.md", "contributing.md",
)


# ------------------------------------------------------------------ authorship


def people(commits: DataFrame) -> DataFrame:
    """One person per lower-cased address, with the name of the newest commit that shows it."""
    return commits.groupBy(ORG, F.lower("author_email").alias("author_email")).agg(
        F.max_by("author_name", F.struct("committed_at", "sha", "author_name")).alias("author_name"),
    ).withColumn("person_id", F.concat(F.lit("person:"), "author_email"))


def newest_commits(commits: DataFrame, per_repository: int | None = None) -> DataFrame:
    """Rows of the newest commits of every repository, of all without a number; commits are ranked once each, not per touched path."""
    if per_repository is None:
        return commits
    keys = [ORG, "repository_id"]
    heads = commits.groupBy(*keys, "sha").agg(F.max("committed_at").alias("_at"))
    kept = top_k(heads, keys, [F.desc("_at"), F.desc("sha")], per_repository, "_r").select(*keys, "sha")
    return commits.join(kept, [*keys, "sha"], "left_semi")


def ownership(commits: DataFrame) -> DataFrame:
    """(org, repo, module, file, author_email, author_name, commit_count, last_commit_at): OWNS edges."""
    return commits.groupBy(ORG, "repository_id", "module_id", "file_id", F.lower("author_email").alias("author_email")).agg(
        F.max("author_name").alias("author_name"), F.count(F.lit(1)).alias("commit_count"), F.max("committed_at").alias("last_commit_at"))


def last_touch(commits: DataFrame) -> DataFrame:
    """Per file: sha, author and time of the newest touch, and how many touches there were."""
    newest = F.max(F.struct("committed_at", "sha", "author_email", "author_name"))
    out = commits.groupBy(ORG, "repository_id", "file_id").agg(newest.alias("_t"), F.count(F.lit(1)).alias("commit_count"))
    return out.select(ORG, "repository_id", "file_id", F.col("_t.sha").alias("sha"), F.col("_t.author_email").alias("author_email"),
                      F.col("_t.author_name").alias("author_name"), F.col("_t.committed_at").alias("committed_at"), "commit_count")


def authored(symbols: DataFrame, touches: DataFrame, commits: DataFrame) -> DataFrame:
    """AUTHORED edges: the file's last author, else the newest committer of the repository."""
    keys = [ORG, "repository_id"]
    default = commits.groupBy(*keys).agg(F.max_by("author_email", F.struct("committed_at", "sha", "author_email")).alias("_default"))
    t = touches.select(*keys, "file_id", F.col("author_email").alias("_mail"), "commit_count")
    return symbols.join(t, [*keys, "file_id"], "left").join(default, keys, "left").select(
        *keys, "symbol_id", F.lower(F.coalesce("_mail", "_default")).alias("author_email"),
        F.coalesce("commit_count", F.lit(1)).alias("commit_count"), F.lit("file_heuristic").alias("source"))


def first_symbols(occurrences: DataFrame) -> DataFrame:
    """One symbol per (file, name): the first occurrence in chunk order."""
    first = F.min(F.struct("start_line", "end_line", "parent_class", "token_count", "is_documented"))
    keys = [ORG, "repository_id", "module_id", "module_name", "file_id", "path", "function_name", "function_id"]
    return occurrences.groupBy(*keys).agg(first.alias("_f")).select(*keys, "_f.*")


def methods_of(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """METHOD_OF edges where the named class exists in the same file."""
    c = classes.select(ORG, "file_id", F.col("symbol_name").alias("parent_class"), F.col("symbol_id").alias("class_id"))
    return functions.where(F.col("parent_class") != "").join(c, [ORG, "file_id", "parent_class"]).select(
        ORG, F.col("function_id"), "class_id")


# ------------------------------------------------------------------ module context


def module_owners(owns: DataFrame, top: int | None = TOP_OWNERS) -> DataFrame:
    """Commits and last activity per (module, author), the ten busiest per module, with the true count."""
    rolled = owns.groupBy(*MODULE, "author_email").agg(
        F.max("author_name").alias("author_name"), F.sum("commit_count").alias("total_commits"), F.max("last_commit_at").alias("last_active"))
    counted = rolled.groupBy(*MODULE).agg(F.count(F.lit(1)).alias("owner_count"))
    ranked = top_k(rolled, MODULE, [F.desc("total_commits"), F.asc("author_email")], top, "owner_rank")
    return ranked.join(counted, MODULE)


def key_files(files: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    n = lambda df, name: df.groupBy(ORG, "file_id").agg(F.count(F.lit(1)).alias(name))
    return files.join(n(functions, "function_count"), [ORG, "file_id"], "left").join(
        n(classes, "class_count"), [ORG, "file_id"], "left").fillna(0, ["function_count", "class_count"])


def entry_points(functions: DataFrame) -> DataFrame:
    return functions.where(F.col("parent_class") == "")


def coverage(functions: DataFrame, modules: DataFrame) -> DataFrame:
    """Documented share of functions per module; a module without functions counts as fully covered."""
    c = functions.groupBy(*MODULE).agg(
        F.count(F.lit(1)).alias("total_functions"), F.count_if("is_documented").alias("documented_functions"))
    out = modules.join(c, MODULE, "left").fillna(0, ["total_functions", "documented_functions"])
    pct = F.when(F.col("total_functions") == 0, F.lit(100.0)).otherwise(
        F.round(F.col("documented_functions") / F.col("total_functions") * 100, 1))
    return out.withColumns({"coverage_pct": pct, "undocumented_functions": F.col("total_functions") - F.col("documented_functions")})


def documentation(documents: DataFrame, modules: DataFrame) -> DataFrame:
    """Linked documents per module and whether one of them is a README or contributing guide."""
    readme = F.upper("filename").contains("README") | F.upper("filename").contains("CONTRIBUTING")
    d = documents.groupBy(*MODULE).agg(F.countDistinct("doc_id").alias("linked_docs"), F.bool_or(readme).alias("has_readme"))
    return modules.join(d, MODULE, "left").fillna({"linked_docs": 0, "has_readme": False})


def module_context(modules: DataFrame, functions: DataFrame, documents: DataFrame, owns: DataFrame) -> DataFrame:
    """One row per module with everything the scores and gap rules read."""
    o = owns.groupBy(*MODULE, "author_email").agg(F.sum("commit_count").alias("_n"), F.max("author_name").alias("_who"))
    o = o.where(F.col("_n") > 0).groupBy(*MODULE).agg(F.count(F.lit(1)).alias("bus_factor"), F.min("_who").alias("sole_owner"))
    entries = entry_points(functions).groupBy(*MODULE).agg(F.count(F.lit(1)).alias("entry_point_count"))
    keys = modules.select(*MODULE)
    return (
        modules.join(coverage(functions, keys), MODULE).join(documentation(documents, keys), MODULE)
        .join(o, MODULE, "left").join(entries, MODULE, "left").fillna(0, ["bus_factor", "entry_point_count"])
    )


# ------------------------------------------------------------------ scores and gaps


def doc_score(coverage_pct, has_readme, linked_docs) -> Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.least(F.lit(100.0), c(coverage_pct) + F.when(c(has_readme), 10.0).otherwise(0.0) + F.least(c(linked_docs) * 5.0, F.lit(15.0)))


def ownership_score(bus_factor) -> Column:
    b = F.col(bus_factor) if isinstance(bus_factor, str) else bus_factor
    return F.round(F.least(b / BUS_FACTOR_TARGET, F.lit(1.0)) * 100, 1)


def overall_score(doc, own) -> Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.round(DOC_WEIGHT * c(doc) + OWNERSHIP_WEIGHT * c(own), 1)


def health_scores(context: DataFrame) -> DataFrame:
    """Scores, risk flags and the ordered gap texts of every module."""
    scored = context.withColumns({
        "doc_score": doc_score("coverage_pct", "has_readme", "linked_docs"), "ownership_score": ownership_score("bus_factor"),
        "sole_owner_risk": F.col("bus_factor") == 1, "unowned": F.col("bus_factor") == 0})
    return scored.withColumns({"overall_score": overall_score("doc_score", "ownership_score"), "gaps": gap_texts()})


def gap_texts() -> Column:
    """Gap sentences in rule order; wording is part of the result."""
    low = (F.col("coverage_pct") < COVERAGE_WARNING) & (F.col("total_functions") > 0)
    bus = F.col("bus_factor")
    return F.array_compact(F.array(
        F.when(low, F.format_string("%d of %d functions missing docstrings (%.1f%% coverage)",
                                    "undocumented_functions", "total_functions", "coverage_pct")),
        F.when(~F.col("has_readme"), F.lit("No README or contributing guide found in this module")),
        F.when(F.col("linked_docs") == 0, F.lit("No linked business documents (PRDs, BRDs) found for this module")),
        F.when(bus == 0, F.lit("No code owners found — module has no git authorship data"))
        .when(bus == 1, F.lit("Bus factor is 1 — only 1 contributor owns this module (high KT risk)"))
        .when(bus == 2, F.lit("Bus factor is 2 — only 2 contributors own this module")),
    ))


def worst_modules(scores: DataFrame, limit: int = 20) -> DataFrame:
    """The lowest scores of every repository, over all its modules."""
    return top_k(scores, [ORG, "repository_id"], [F.asc("overall_score"), F.asc("module_id")], limit, "position")


def gap_signals(context: DataFrame, functions: DataFrame, has_manifest: DataFrame | None = None, cap: int = SIGNAL_CAP) -> DataFrame:
    """(org, module, position, type, severity, entity, description): the capped signals of each module.

    Signals per function are pre-ranked where they are made (only ``cap`` of a module can survive), so
    a module with very many functions sends few rows on.
    """
    def row(df: DataFrame, kind: str, severity: int, entity: Column, text: Column, seq: Column) -> DataFrame:
        return df.select(*MODULE, F.lit(kind).alias("type"), F.lit(severity).alias("severity"),
                         entity.cast("string").alias("entity"), text.alias("description"), seq.cast("string").alias("_seq"))

    undocumented = functions.where(~F.col("is_documented"))
    big = F.col("token_count") > COMPLEX_TOKENS
    dotted = F.concat_ws(".", "parent_class", "function_name")
    none = F.lit("")
    c = context
    if has_manifest is not None:
        c = c.join(has_manifest, MODULE, "left")
    else:
        c = c.withColumn("manifest_status", F.lit("found"))
    per_function = (
        row(undocumented.where(big), "complex_undocumented", 1, F.col("function_name"),
            F.format_string("Function '%s' (%d tokens) is undocumented and complex", "function_name", "token_count"), F.col("function_id"))
        .unionByName(row(undocumented.where(~big & (F.col("parent_class") != "")), "undocumented_method", 4, dotted,
                         F.format_string("Method '%s' is undocumented", dotted), F.col("function_id")))
        .unionByName(row(undocumented.where(F.col("parent_class") == ""), "undocumented_function", 3, F.col("function_name"),
                         F.format_string("Entry function '%s' in '%s' has no docstring", "function_name", "path"), F.col("function_id")))
    )
    sole_text = F.format_string(
        "All files in module are owned solely by '%s' (bus-factor risk; ownership is file-level last-author, not per-function)", "sole_owner")
    per_module = (
        row(c.where(F.col("bus_factor") == 1), "sole_owner_file", 2, F.col("sole_owner"), sole_text, none)
        .unionByName(row(c.where(F.col("bus_factor") == 0), "no_owners", 2, none, F.lit("No git commit authorship records found for files in this module"), none))
        .unionByName(row(c.where(F.col("linked_docs") == 0), "no_linked_docs", 5, none, F.lit("No documentation files linked to this module"), none))
        .unionByName(row(c.where(~F.col("has_readme")), "no_readme", 6, none, F.lit("Module has no linked README or overview document"), none))
        .unionByName(row(c.where((F.col("coverage_pct") < LOW_COVERAGE) & (F.col("total_functions") > 0)), "low_doc_coverage", 7, F.col("coverage_pct"),
                         F.format_string("Module function documentation coverage is low (%.1f%%)", "coverage_pct"), none))
        .unionByName(row(c.where(F.col("manifest_status") == "not_found"), "no_dependency_manifest", 8, none,
                         F.lit("No repository dependency manifest (requirements.txt, package.json, etc.) found"), none))
        .unionByName(row(c, "cross_module_deps_unknown", 9, none, F.lit("Cross-module dependency graph not yet available"), none))
    )
    return top_k(per_function.unionByName(per_module), MODULE, [F.asc("severity"), F.asc("_seq")], cap, "position").drop("_seq")


# Question wording per signal type, and the types asked once per module.
QUESTION_TEXT = {
    "complex_undocumented": "Walk me through `%s` — it is a large function with no docstring. What are its non-obvious behaviors or edge cases?",
    "undocumented_function": "What does `%s` do, and what was the design rationale behind its signature?",
    "undocumented_method": "What is the expected contract and state lifecycle for `%s`?",
    "sole_owner_file": "You are the primary committer for these files (%s). What unwritten rules or operational gotchas should a maintainer know?",
    "no_owners": "No active git commit owner was found for this module. Who originally authored it and who can be consulted for legacy context?",
    "no_linked_docs": "There are no linked documentation files for this module. Where is tribal knowledge or architectural intent recorded?",
    "no_readme": "There is no README for this module. What is the recommended entry path for exploring this codebase?",
    "low_doc_coverage": "Documentation coverage across this module is under 50%%. Which specific undocumented areas have the highest risk of regression?",
    "no_dependency_manifest": "No build/dependency manifest file was found. What external runtime services or environment variables are required to run this?",
    "cross_module_deps_unknown": "What other modules or external APIs does this module interface with, and are there known coupling issues?",
}
ASKED_ONCE = (
    "undocumented_function", "undocumented_method", "no_linked_docs", "no_readme", "low_doc_coverage",
    "no_dependency_manifest", "cross_module_deps_unknown",
)
NO_GAPS_TEXT = "This module is well-documented. No critical knowledge gaps requiring dedicated KT session questions were identified."


def rule_questions(signals: DataFrame, cap: int = QUESTION_CAP) -> DataFrame:
    """Numbered questions of each module from its signals (at most fifteen rows per module)."""
    by_type = Window.partitionBy(*MODULE, "type").orderBy("position")
    rows = signals.withColumn("_nth", F.row_number().over(by_type)).where(~F.col("type").isin(*ASKED_ONCE) | (F.col("_nth") == 1))
    needs_entity = F.col("type").isin("complex_undocumented", "undocumented_function", "undocumented_method", "sole_owner_file")
    rows = rows.where(~needs_entity | (F.col("entity") != ""))
    text = F.lit(None).cast("string")
    for kind, template in QUESTION_TEXT.items():
        args = ["entity"] if "%s" in template else []
        text = F.when(F.col("type") == kind, F.format_string(template, *args)).otherwise(text)
    asked = top_k(rows.withColumn("question", text), MODULE, [F.asc("position")], cap, "number")
    return asked.select(*MODULE, "number", "type", F.concat(F.col("number").cast("string"), F.lit(". "), "question").alias("question"))


def question_lists(signals: DataFrame, provider: str = "stub", generate=None) -> DataFrame:
    """Question text per module and how it came about: no gaps, rules, or a text provider with rules behind it."""
    real = signals.groupBy(*MODULE).agg(
        F.count_if(F.col("type") != "cross_module_deps_unknown").alias("real_gaps"), F.count(F.lit(1)).alias("signal_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "description"))), lambda s: F.concat(F.lit("- "), s["description"])), "\n").alias("gap_text"))
    asked = rule_questions(signals).groupBy(*MODULE).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "question"))), lambda q: q["question"]), "\n").alias("_rules"))
    rows = real.join(asked, MODULE, "left")
    made = F.lit(None).cast("string") if provider == "stub" or generate is None else generate(F.col("gap_text"))
    rows = rows.withColumn("_made", F.when(F.length(F.trim(made)) > 10, F.trim(made)))
    return rows.select(
        *MODULE, "signal_count",
        F.when(F.col("real_gaps") == 0, F.lit(NO_GAPS_TEXT)).otherwise(F.coalesce("_made", "_rules")).alias("questions"),
        F.when(F.col("real_gaps") == 0, "no_gaps_detected").when(F.col("_made").isNotNull(), "llm").otherwise("rule_based_fallback").alias("generation_method"))


def grounding(generated: DataFrame, people_: DataFrame, known_files: DataFrame) -> DataFrame:
    """Quality flag per module text: addresses or files it names that the module does not have."""
    mails = generated.select(*MODULE, F.explode(emails("generated_text")).alias("named"))
    known_mail = people_.select(*MODULE, F.lower("author_email").alias("named")).distinct()
    odd_mail = mails.join(known_mail, [*MODULE, "named"], "left_anti")
    mentioned = generated.select(*MODULE, F.explode(file_mentions("generated_text")).alias("named")).where(~F.col("named").isin(*KNOWN_MANIFESTS))
    known_file = known_files.select(*MODULE, F.lower(paths.name("path")).alias("named")).distinct()
    odd = odd_mail.unionByName(mentioned.join(known_file, [*MODULE, "named"], "left_anti")).groupBy(*MODULE).agg(
        F.count(F.lit(1)).alias("unknown_mentions"))
    return generated.join(odd, MODULE, "left").fillna(0, ["unknown_mentions"]).withColumn(
        "generation_quality", F.when(F.col("unknown_mentions") > 0, "grounding_warning").otherwise("ok"))


def first_tasks(context: DataFrame) -> DataFrame:
    """(org, module, seq, priority, description, rationale): rule-based onboarding tasks."""
    tasks = F.array_compact(F.array(
        F.when(~F.col("has_readme"), F.struct(
            F.lit(1).alias("seq"), F.lit("high").alias("priority"),
            F.format_string("Create a README.md for module '%s'", "module_name").alias("description"),
            F.lit("Module has no linked overview or README documentation.").alias("rationale"))),
        F.when(F.col("undocumented_functions") > 0, F.struct(
            F.lit(2).alias("seq"), F.lit("medium").alias("priority"),
            F.format_string("Add docstrings to %d undocumented functions", "undocumented_functions").alias("description"),
            F.format_string("Estimated function documentation coverage is %.1f%%.", "coverage_pct").alias("rationale"))),
        F.when(F.col("entry_point_count") == 0, F.struct(
            F.lit(3).alias("seq"), F.lit("low").alias("priority"),
            F.lit("Identify and document main module entry points").alias("description"),
            F.lit("No top-level exported functions were classified in AST parsing.").alias("rationale"))),
    ))
    return context.select(*MODULE, F.explode(tasks).alias("_t")).select(*MODULE, "_t.*")


def average_health(scores: DataFrame) -> DataFrame:
    return scores.groupBy(ORG).agg(F.round(F.avg("overall_score")).cast("int").alias("average_health"))


# ------------------------------------------------------------------ onboarding packs


def onboarding_packs(context: DataFrame, files_view: DataFrame, owners: DataFrame, documents: DataFrame, tasks: DataFrame,
                     entries: DataFrame, limit: int | None = None) -> DataFrame:
    """One nested pack per module with all rows of each section, or the first ``limit`` of them.

    A pack is as large as its module. With a limit a section is ranked and cut before it is collected.
    """
    def section(df: DataFrame, order: list[Column], name: str, *cols: str) -> DataFrame:
        cut = top_k(df, MODULE, order, limit, "_pos")
        packed = F.array_sort(F.collect_list(F.struct("_pos", *cols)))
        return cut.groupBy(*MODULE).agg(F.transform(packed, lambda s: F.struct(*[s[c].alias(c) for c in cols])).alias(name))

    out = context
    for part in (
        section(files_view, [F.asc("path")], "key_files", "path", "function_count", "class_count"),
        section(owners, [F.asc("owner_rank")], "who_to_talk_to", "author_name", "author_email", "total_commits"),
        section(documents, [F.asc("relative_path"), F.asc("doc_id")], "existing_docs", "filename", "relative_path", "version"),
        section(entries, [F.asc("function_id")], "entry_points", "function_name", "path", "is_documented"),
        section(tasks, [F.asc("seq")], "suggested_first_tasks", "priority", "description", "rationale"),
    ):
        out = out.join(part, MODULE, "left")
    purpose = F.format_string("Module '%s' contains %d functions/methods.", "module_name", "total_functions")
    return out.withColumns({"module_purpose": purpose, "generation_method": F.lit("stub")})


def onboarding_markdown(packs: DataFrame) -> DataFrame:
    """The pack as Markdown: (org, module_id, markdown)."""
    def rows(c: str, line, empty: str, head: str = "") -> Column:
        body = F.array_join(F.transform(F.col(c), line), "\n")
        return F.when(F.size(F.coalesce(F.col(c), F.array())) > 0, F.concat(F.lit(head), body)).otherwise(F.lit(empty))

    yes_no = lambda x, y, n: F.when(x, y).otherwise(n)
    s = lambda x: x.cast("string")
    sections = [
        F.format_string("# Developer Onboarding Pack: `%s`", "module_name"),
        F.concat(F.lit("## 1. Module Purpose & Overview\n\n"), "module_purpose"),
        F.concat(F.lit("## 2. Key Files\n\n"), rows(
            "key_files", lambda f: F.concat(F.lit("| `"), paths.name(f["path"]), F.lit("` | `"), f["path"], F.lit("` | "), s(f["function_count"]), F.lit(" | "), s(f["class_count"]), F.lit(" |")),
            "*No source files found in this module.*", "| Filename | Relative Path | Functions | Classes |\n| --- | --- | --- | --- |\n")),
        F.concat(F.lit("## 3. Entry Points & Top-Level Functions\n\n"), rows(
            "entry_points", lambda f: F.concat(F.lit("| `"), f["function_name"], F.lit("` | `"), f["path"], F.lit("` | "), yes_no(f["is_documented"], "✅ Yes", "⚠️ No"), F.lit(" |")),
            "*No top-level entry functions identified.*", "| Function Name | File Path | Documented? |\n| --- | --- | --- |\n")),
        F.concat(F.lit("## 4. Who To Talk To (Code Owners)\n\n"), rows(
            "who_to_talk_to", lambda o: F.concat(F.lit("| "), o["author_name"], F.lit(" | `"), o["author_email"], F.lit("` | "), s(o["total_commits"]), F.lit(" |")),
            "*No git commit authorship records found for files in this module.*", "| Name | Email | Total Commits |\n| --- | --- | --- |\n")),
        F.concat(F.lit("## 5. Existing Documentation\n\n"), rows(
            "existing_docs", lambda d: F.concat(F.lit("### `"), d["filename"], F.lit("` (`"), d["relative_path"], F.lit("`, v"), s(d["version"]), F.lit(")")),
            "*No documentation files currently linked to this module.*")),
        F.format_string("## 8. Documentation Coverage & Health\n\n- **Total AST Functions/Methods:** %d\n- **Documented Functions:** %d\n- **Estimated Function Coverage:** %.1f%%",
                        "total_functions", "documented_functions", "coverage_pct"),
        F.concat(F.lit("## 9. Suggested First Onboarding Tasks\n\n"), rows(
            "suggested_first_tasks", lambda t: F.concat(F.lit("- **["), F.upper(t["priority"]), F.lit("]** "), t["description"], F.lit("  \n  *Rationale:* "), t["rationale"]),
            "*No specific initial onboarding tasks generated.*")),
    ]
    return packs.select(*MODULE, F.concat_ws("\n\n", *sections).alias("markdown"))
