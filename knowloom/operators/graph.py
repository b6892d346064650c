"""Entity graph: fixed-depth traversals, expansions, topology and graph upkeep, all as hash joins.

Small sides are left to adaptive execution, which broadcasts them on measured size.  Sides that could
multiply each other are aggregated on their own before they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from ..session import staged
from . import substrings
from .retrieval import top_k

ORG = "organization_id"

# Display colour, size and badge per label.
NODE_STYLE = {
    "Repository": ("#17201d", 26.0, "Repo"), "Module": ("#5579e8", 18.0, "Module"), "File": ("#44833f", 12.0, "File"),
    "Function": ("#ed7c4a", 8.0, "Function"), "Class": ("#8d6aca", 10.0, "Class"), "Person": ("#c85b52", 11.0, "Owner"),
    "Document": ("#0d9488", 14.0, "Doc"), "Package": ("#eab308", 9.0, "Package"),
}
DEFAULT_STYLE = ("#64748b", 9.0)
HIDDEN_PROPERTIES = ("embedding", "vector", "content")
MANIFEST_DOC_NAMES = ("requirements.txt", "package.json", "pyproject.toml", "pipfile", "environment.yml", "setup.py")


def owners_by_file(owns: DataFrame) -> DataFrame:
    """(org, file_id, owners): sorted (email, name, commit_count) structs.

    A list has one entry per author who touched the file, however many there are; a caller that wants fewer cuts before.
    """
    return owns.groupBy(ORG, "file_id").agg(F.array_sort(F.collect_set(F.struct("author_email", "author_name", "commit_count"))).alias("owners"))


def symbol_targets(questions: DataFrame, symbols: DataFrame) -> DataFrame:
    """Questions (org, entity_name) matched to symbols by name, or by the tail of a qualified id.

    The id ends with ``::name`` exactly when the part after its last ``::`` is the name, or the name
    itself is qualified; both are equalities.
    """
    tail = F.substring_index("symbol_id", "::", -1)
    return symbols.withColumn("entity_name", F.explode(F.array_distinct(F.array("symbol_name", tail)))).join(
        questions.select(ORG, "entity_name").distinct(), [ORG, "entity_name"])


def siblings_in_module(questions: DataFrame, functions: DataFrame, owns: DataFrame) -> DataFrame:
    """For each asked function: every other function of its module, with the owners of its file."""
    t = symbol_targets(questions, functions).select(ORG, "entity_name", "module_id", "symbol_id")
    # one row per (name, module): a function is excluded only when it is the sole target there
    asked = t.groupBy(ORG, "entity_name", "module_id").agg(F.min("symbol_id").alias("_lo"), F.max("symbol_id").alias("_hi"))
    rows = functions.join(asked, [ORG, "module_id"]).where(
        (F.col("symbol_id") != F.col("_lo")) | (F.col("symbol_id") != F.col("_hi")))
    return rows.drop("_lo", "_hi").join(owners_by_file(owns), [ORG, "file_id"], "left")


def siblings_in_file(questions: DataFrame, functions: DataFrame, owns: DataFrame) -> DataFrame:
    t = symbol_targets(questions, functions).select(ORG, "entity_name", "file_id", "symbol_id")
    asked = t.groupBy(ORG, "entity_name", "file_id").agg(F.min("symbol_id").alias("_lo"), F.max("symbol_id").alias("_hi"))
    rows = functions.join(asked, [ORG, "file_id"]).where(
        (F.col("symbol_id") != F.col("_lo")) | (F.col("symbol_id") != F.col("_hi")))
    return rows.drop("_lo", "_hi").join(owners_by_file(owns), [ORG, "file_id"], "left")


def files_by_path(questions: DataFrame, files: DataFrame) -> DataFrame:
    """Questions (org, entity_name) matched to files whose path ends with the name.

    Whole trailing parts match by equality; a name that stops inside a part matches through the
    endings of the first part it reaches, restricted to the asked endings.
    """
    asked = questions.select(ORG, "entity_name").distinct()
    last = paths.name("entity_name")
    keyed = asked.withColumn("_len", F.length(last)).withColumn("_end", F.lower(F.right(F.concat(F.lit(" " * 8), last), F.lit(8))))
    base = paths.name("path")
    mine = files.withColumn("_tails", F.array_distinct(F.array(
        *[F.lower(F.right(F.concat(F.lit(" " * 8), F.right(base, F.lit(n))), F.lit(8))) for n in range(1, 9)])))
    return mine.withColumn("_end", F.explode("_tails")).drop("_tails").join(keyed, [ORG, "_end"]).where(
        F.col("path").endswith(F.col("entity_name"))).drop("_end", "_len").distinct()


def file_symbols(questions: DataFrame, files: DataFrame, functions: DataFrame, classes: DataFrame, owns: DataFrame) -> DataFrame:
    """Per asked file: its functions, classes and owners, each list aggregated before the joins.

    The lists of a file grow with its symbols and authors; files themselves have no limit unless ingestion sets one.
    """
    f = files_by_path(questions, files)
    pick = lambda df, name: df.join(f.select(ORG, "file_id").distinct(), [ORG, "file_id"], "left_semi").groupBy(ORG, "file_id").agg(
        F.array_sort(F.collect_set(F.struct("symbol_name", "start_line", "end_line"))).alias(name))
    return f.join(pick(functions, "functions"), [ORG, "file_id"], "left").join(
        pick(classes, "classes"), [ORG, "file_id"], "left").join(owners_by_file(owns), [ORG, "file_id"], "left")


def containing_file(questions: DataFrame, functions: DataFrame, classes: DataFrame, owns: DataFrame) -> DataFrame:
    cols = [ORG, "repository_id", "module_id", "file_id", "path", "symbol_id", "symbol_name", "start_line", "end_line"]
    both = functions.select(*cols, F.lit("Function").alias("symbol_type")).unionByName(
        classes.select(*cols, F.lit("Class").alias("symbol_type")))
    return symbol_targets(questions, both).join(owners_by_file(owns), [ORG, "file_id"], "left")


def containing_module(questions: DataFrame, files: DataFrame, owns: DataFrame) -> DataFrame:
    return files_by_path(questions, files).join(owners_by_file(owns), [ORG, "file_id"], "left")


def structural_answers(questions: DataFrame, files: DataFrame, functions: DataFrame, classes: DataFrame, owns: DataFrame) -> DataFrame:
    """Route classified questions to their traversal; one summary row per found entity."""
    def of(label: str) -> DataFrame:
        return questions.where(F.col("intent") == label)

    def summary(df: DataFrame, label: str, text: Column, chunk: Column) -> DataFrame:
        return df.select(ORG, "entity_name", F.lit(label).alias("intent"), chunk.alias("chunk_id"), text.alias("text"),
                         F.lit(1.0).alias("similarity_score"), F.size(F.coalesce("owners", F.array())).alias("owner_count"))

    fn_text = F.format_string("# Function: %s\n# File: %s (lines %d-%d)\n# Module: %s", "symbol_name", "path", "start_line", "end_line", "module_name")
    names = lambda c: F.coalesce(F.nullif(F.array_join(F.transform(F.col(c), lambda s: s["symbol_name"]), ", "), F.lit("")), F.lit("None"))
    sym_text = F.format_string("# File: %s\n# Classes: %s\n# Functions: %s", F.col("path"), names("classes"), names("functions"))
    file_text = F.format_string("# Symbol: %s (%s)\n# File: %s\n# Module: %s", F.col("symbol_name"), F.col("symbol_type"), F.col("path"), F.substring_index("module_id", ":", -1))
    mod_text = F.format_string("# Symbol: %s (%s)\n# File: %s\n# Module: %s", F.col("path"), F.lit("File"), F.col("path"), F.col("module_name"))
    return (
        summary(siblings_in_module(of("SAME_MODULE_FUNCTIONS"), functions, owns), "SAME_MODULE_FUNCTIONS", fn_text, F.col("symbol_id"))
        .unionByName(summary(siblings_in_file(of("SAME_FILE_FUNCTIONS"), functions, owns), "SAME_FILE_FUNCTIONS", fn_text, F.col("symbol_id")))
        .unionByName(summary(file_symbols(of("FILE_SYMBOLS"), files, functions, classes, owns), "FILE_SYMBOLS", sym_text, F.col("file_id")))
        .unionByName(summary(containing_file(of("CONTAINING_FILE"), functions, classes, owns), "CONTAINING_FILE", file_text, F.col("file_id")))
        .unionByName(summary(containing_module(of("CONTAINING_MODULE"), files, owns), "CONTAINING_MODULE", mod_text, F.col("file_id")))
    )


def module_documents(files: DataFrame, documents: DataFrame) -> DataFrame:
    """(org, module_id, id, path): linked documents and document-like files of every module, each once."""
    linked = documents.select(ORG, "module_id", F.col("doc_id").alias("id"), F.col("relative_path").alias("path"))
    alike = files.where(F.lower("path").rlike(r"\.(md|rst|txt)$") | F.col("path").contains("README")).select(
        ORG, "module_id", F.col("file_id").alias("id"), "path")
    return linked.unionByName(alike).dropDuplicates([ORG, "module_id", "id"])


def related_documents(keys: DataFrame, files: DataFrame, documents: DataFrame) -> DataFrame:
    """(org, file_id, id, path) rows for the files of a result page: documents of the module or of the root module.

    The either/or on the module is one equality after each file names both modules.
    """
    f = files.join(keys.select(ORG, "file_id").distinct(), [ORG, "file_id"], "left_semi")
    both = F.array_distinct(F.array("module_id", F.concat("repository_id", F.lit(":module:_root"))))
    rows = f.select(ORG, "file_id", F.explode(both).alias("module_id")).join(module_documents(files, documents), [ORG, "module_id"])
    return rows.where(F.col("id") != F.col("file_id")).select(ORG, "file_id", "id", "path")


def expand_code(keys: DataFrame, files: DataFrame, owns: DataFrame, documents: DataFrame) -> DataFrame:
    """Context of any number of files: module, repository, owners, how many documents relate and the first of them.

    Counts and the two smallest ids are made per module before the join, so wide modules do not fan
    out; ``related_documents`` lists the rows themselves for a page.
    """
    f = files.join(keys.select(ORG, "file_id").distinct(), [ORG, "file_id"], "left_semi")
    docs = module_documents(files, documents)
    size = docs.groupBy(ORG, "module_id").agg(F.count(F.lit(1)).alias("_n"))
    two = top_k(docs.select(ORG, "module_id", "id"), [ORG, "module_id"], [F.asc("id")], 2, "_r").groupBy(ORG, "module_id").agg(
        F.collect_list("id").alias("_ids"))
    per_module = size.join(two, [ORG, "module_id"])
    own = per_module.select(ORG, "module_id", F.col("_n").alias("_n0"), F.col("_ids").alias("_i0"))
    top = per_module.select(ORG, F.col("module_id").alias("_root"), F.col("_n").alias("_n1"), F.col("_ids").alias("_i1"))
    itself = docs.select(ORG, "module_id", F.col("id").alias("file_id"), F.lit(1).alias("_self"))
    f = f.withColumn("_root", F.concat("repository_id", F.lit(":module:_root")))
    f = f.join(own, [ORG, "module_id"], "left").join(top, [ORG, "_root"], "left").join(itself, [ORG, "module_id", "file_id"], "left").join(
        owners_by_file(owns), [ORG, "file_id"], "left")
    zero, none = F.lit(0).cast("long"), F.array().cast("array<string>")
    count = F.coalesce("_n0", zero) + F.when(F.col("module_id") == F.col("_root"), zero).otherwise(F.coalesce("_n1", zero)) - F.coalesce("_self", F.lit(0))
    seen = F.filter(F.concat(F.coalesce("_i0", none), F.coalesce("_i1", none)), lambda i: i != F.col("file_id"))
    return f.select(ORG, "file_id", "repository_id", "module_id", "owners", count.alias("related_count"), F.array_min(seen).alias("first_related"))


def expand_documents(keys: DataFrame, documents: DataFrame, files: DataFrame) -> DataFrame:
    """Context of documents: module, repository and how many code files, in which order, its repository has.

    A repository's files are reduced to one row before the join, so wide repositories do not fan out.
    """
    per_repo = files.groupBy(ORG, "repository_id").agg(
        F.count(F.lit(1)).alias("related_code_files"), F.min("path").alias("first_code_file"))
    d = documents.join(keys.select(ORG, "doc_id").distinct(), [ORG, "doc_id"], "left_semi")
    return d.join(per_repo, [ORG, "repository_id"], "left").select(
        ORG, "doc_id", "repository_id", "module_id", F.coalesce("related_code_files", F.lit(0)).alias("related_code_files"), "first_code_file")


# ------------------------------------------------------------------ topology and display


def topology_modules(repositories: DataFrame, modules: DataFrame, limit: int | None = None) -> DataFrame:
    """Repositories with their modules, at most ``limit`` rows for each tenant."""
    rows = repositories.join(modules, [ORG, "repository_id"], "left")
    return top_k(rows, [ORG], [F.asc("repository_id"), F.col("module_id").asc_nulls_last()], limit, "_n").drop("_n")


def topology_files(files: DataFrame, owns: DataFrame, documents: DataFrame, limit: int | None = None) -> DataFrame:
    """Files with owner and document counts; the limit applies to the files of each tenant, in a fixed order."""
    o = owns.groupBy(ORG, "file_id").agg(F.countDistinct("author_email").alias("owner_count"))
    d = documents.groupBy(ORG, "module_id").agg(F.countDistinct("doc_id").alias("document_count"))
    page = top_k(files, [ORG], [F.asc("file_id")], limit, "_n").drop("_n")
    return page.join(o, [ORG, "file_id"], "left").join(d, [ORG, "module_id"], "left").fillna(0, ["owner_count", "document_count"])


def links_within(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links whose two ends are both among the nodes."""
    ids = nodes.select(ORG, F.col("id").alias("_id")).distinct()
    return links.join(ids, (links[ORG] == ids[ORG]) & (links["source"] == ids["_id"]), "left_semi").join(
        ids, (links[ORG] == ids[ORG]) & (links["target"] == ids["_id"]), "left_semi")


def clean_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """No self links, each (source, type, target) once, no dangling ends."""
    unique = links.where(F.col("source") != F.col("target")).dropDuplicates([ORG, "source", "type", "target"])
    return links_within(unique, nodes)


def format_nodes(nodes: DataFrame) -> DataFrame:
    """Display columns: colour, badge, size (from loc, else complexity, clamped) and the shown name."""
    label = F.col("label")
    pick = lambda i, default: F.coalesce(F.try_element_at(F.create_map(
        *[F.lit(x) for k, v in NODE_STYLE.items() for x in (k, v[i])]), label), default)
    base = pick(1, F.lit(DEFAULT_STYLE[1]))
    clamp = lambda v, top: F.least(F.lit(top), F.greatest(F.lit(8.0), v))
    size = F.when(F.col("loc").isNotNull(), clamp(base + F.col("loc") / 150, 30.0)).when(
        F.col("complexity").isNotNull(), clamp(base + F.col("complexity") / 4, 25.0)).otherwise(base)
    shown = F.when((label == "File") & F.col("path").isNotNull(), paths.name("path")).otherwise(F.coalesce("name", "path", "id"))
    return nodes.drop(*HIDDEN_PROPERTIES).withColumns({
        "color": pick(0, F.lit(DEFAULT_STYLE[0])), "badge": pick(2, label), "val": F.round(size, 1), "display_name": shown})


def neighbours(centres: DataFrame, links: DataFrame) -> DataFrame:
    """One hop in both directions inside the tenant: (org, centre, neighbour, type, direction)."""
    c = centres.select(ORG, F.col("id").alias("centre")).distinct()
    out = links.select(ORG, F.col("source").alias("centre"), F.col("target").alias("neighbour"), "type", F.lit("out").alias("direction"))
    back = links.select(ORG, F.col("target").alias("centre"), F.col("source").alias("neighbour"), "type", F.lit("in").alias("direction"))
    return out.unionByName(back).join(c, [ORG, "centre"], "left_semi")


def search_nodes(nodes: DataFrame, asked: DataFrame, limit: int | None = 50) -> DataFrame:
    """Case-insensitive substring search on name and path: the first ``limit`` nodes of each question, in a fixed order.

    ``asked``: tenant and query_text. A question only ever meets nodes of its own tenant, and of those the ones that hold
    its rarest gram; a blank question finds nothing.
    """
    needles = asked.select(ORG, "query_text").distinct().withColumn("needle", F.lower(F.trim("query_text")))
    nodes = staged(nodes)  # postings, the texts that are looked at and the hits all read them
    named = F.lower(F.concat_ws("\n", "name", "path"))
    found = substrings.find(nodes.select(ORG, "id", named.alias("text")).distinct(), needles, ["id"], [ORG])
    hits = nodes.join(found.join(needles, [ORG, "needle"]).select(ORG, "id", "query_text").distinct(), [ORG, "id"])
    return top_k(hits, [ORG, "query_text"], [F.asc("name"), F.asc("id")], limit, "position")


def repository_listing(repositories: DataFrame, modules: DataFrame, files: DataFrame, documents: DataFrame) -> DataFrame:
    """Repositories with distinct module, file and document counts, each counted before the join."""
    keys = [ORG, "repository_id"]
    n = lambda df, c, name: df.groupBy(*keys).agg(F.countDistinct(c).alias(name))
    out = repositories.join(n(modules, "module_id", "module_count"), keys, "left").join(
        n(files, "file_id", "file_count"), keys, "left").join(n(documents, "doc_id", "document_count"), keys, "left")
    return out.fillna(0, ["module_count", "file_count", "document_count"])


def module_topology(modules: DataFrame, files: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    """Per module: distinct files, functions and classes."""
    keys = [ORG, "module_id"]
    n = lambda df, c, name: df.groupBy(*keys).agg(F.countDistinct(c).alias(name))
    out = modules.join(n(files, "file_id", "file_count"), keys, "left").join(
        n(functions, "symbol_id", "function_count"), keys, "left").join(n(classes, "symbol_id", "class_count"), keys, "left")
    return out.fillna(0, ["file_count", "function_count", "class_count"])


def resolve_modules(ids: DataFrame, modules: DataFrame, files: DataFrame) -> DataFrame:
    """Asked ids (org, asked_id) to modules: a module id with or without its repo: prefix, else a file's module."""
    bare = F.regexp_replace("module_id", "^repo:", "")
    m = modules.select(ORG, "module_id", F.explode(F.array_distinct(F.array("module_id", bare))).alias("asked_id"))
    direct = ids.join(m, [ORG, "asked_id"]).select(ORG, "asked_id", "module_id", F.lit("module").alias("matched_as"))
    rest = ids.join(direct, [ORG, "asked_id"], "left_anti")
    by_file = rest.join(files.select(ORG, F.col("file_id").alias("asked_id"), "module_id"), [ORG, "asked_id"])
    return direct.unionByName(by_file.select(ORG, "asked_id", "module_id", F.lit("file").alias("matched_as")))


def linked_documents_with_excerpt(documents: DataFrame, chunks: DataFrame, size: int = 300) -> DataFrame:
    """Documents of modules with version (1 when unknown) and the start of their first chunk."""
    lead = chunks.groupBy(ORG, "doc_id").agg(F.min_by("text", "chunk_index").alias("_t"))
    return documents.join(lead, [ORG, "doc_id"], "left").select(
        ORG, "module_id", "doc_id", "filename", F.coalesce("version", F.lit(1)).alias("version"),
        F.coalesce(F.left("_t", F.lit(size)), F.lit("")).alias("lead_excerpt"))


def module_packages(used_by: DataFrame, packages: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", "name", "version")
    return used_by.join(packages, [ORG, "repository_id", "package_id"]).select(ORG, "module_id", text.alias("dependency")).distinct()


def repository_manifests(modules: DataFrame, documents: DataFrame) -> DataFrame:
    """Manifest documents of a module's whole repository, collected per repository before the join."""
    found = documents.where(F.lower("filename").isin(*MANIFEST_DOC_NAMES)).groupBy(ORG, "repository_id").agg(
        F.array_sort(F.collect_set("filename")).alias("manifest_files"), F.countDistinct("relative_path").alias("manifest_count"))
    return modules.join(found, [ORG, "repository_id"], "left").withColumn(
        "status", F.when(F.col("manifest_count") > 0, "found").otherwise("not_found"))


def callers(targets: DataFrame, calls: DataFrame, limit: int = 5) -> DataFrame:
    """Up to five callers per (org, path, callee), by name."""
    rows = targets.select(ORG, "path", "callee").distinct().join(calls, [ORG, "path", "callee"])
    return top_k(rows.select(ORG, "path", "callee", "caller").distinct(), [ORG, "path", "callee"], [F.asc("caller")], limit, "position")


def resolve_business_chunk(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Asked chunk ids to chunks of the parent document: the same id, else an id that ends so, else the first."""
    parent = F.when(F.contains("asked_id", F.lit(":chunk:")), F.regexp_replace("asked_id", r":chunk:(?!.*:chunk:).*$", "")).otherwise(F.col("asked_id"))
    rows = asked.withColumn("doc_id", parent).join(chunks, [ORG, "doc_id"])
    how = F.when(F.col("chunk_id") == F.col("asked_id"), 0).when(F.col("chunk_id").endswith(F.col("asked_id")), 1).otherwise(2)
    return top_k(rows.withColumn("_how", how), [ORG, "asked_id"], [F.asc("_how"), F.asc("chunk_index")], 1, "_p").drop("_p")


# ------------------------------------------------------------------ client-side views


def induced_subgraph(nodes: DataFrame, links: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    kept = nodes.where(F.col("label").isin(*labels))
    return kept, links_within(links, kept)


def adjacency(links: DataFrame) -> DataFrame:
    """Distinct undirected neighbours as rows and degree; sets are built per node from distinct rows."""
    both = links.select(ORG, "source", "target").unionByName(links.select(ORG, F.col("target").alias("source"), F.col("source").alias("target")))
    return both.where(F.col("source") != F.col("target")).distinct()


def merge_expansion(current: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """Keep what is shown, add only rows with new keys."""
    return current.unionByName(added.dropDuplicates(keys).join(current, keys, "left_anti"))
