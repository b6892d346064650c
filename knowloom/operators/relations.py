"""Edges read from source text: imports, calls, inheritance, tests, packages, module links.

Files come as (organization_id, repository_id, path, text).  Everything that can be settled inside one
file is done in its row with array expressions (exploded as outer rows, since the inner form evaluates
its array once more to filter); joins only look up other files, and the looked-up side
is always reduced to one row per key first, so popular names cannot multiply pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from ..functions.text import col, strip

REPO = ["organization_id", "repository_id"]

# Statement patterns.
PY_IMPORT = r"^(?:from\s+([\w.]+)\s+import\b|import\s+([\w.]+))"
JS_IMPORT = r"(?:import\s+.*?from\s+['\"]([^'\"]+)['\"]|require\s*\(\s*['\"]([^'\"]+)['\"]\s*\))"
JS_ENDINGS = ("", ".js", ".ts", ".jsx", ".tsx", "/index.js", "/index.ts")
DEFINITION = r"^(?:async\s+)?def\s+(\w+)|\bfunction\s+(\w+)|\bconst\s+(\w+)\s*="
DEFINITION_SITE = r"\b(?:def|function)\s+\w+\s*\("
CALL = r"(\w+)\s*\("
PY_CLASS = r"class\s+([A-Za-z0-9_]+)\s*\(\s*([A-Za-z0-9_\.]+)\s*\)\s*:"
JS_CLASS = r"class\s+([A-Za-z0-9_]+)\s+extends\s+([A-Za-z0-9_]+)"
REQUIREMENT = r"^([A-Za-z0-9_\-\.]+)\s*(.*)$"
MODULE_STOP_TOKENS = (
    "api", "test", "util", "utils", "index", "main", "init", "base",
    "core", "lib", "src", "app", "web", "doc", "docs", "readme",
    "changelog", "license", "todo",
)
SCRIPT_SUFFIXES = (".js", ".jsx", ".ts", ".tsx")


def _first_group(text: Column, pattern: str, groups: int) -> Column:
    found = [F.nullif(F.regexp_extract(text, pattern, g + 1), F.lit("")) for g in range(groups)]
    return F.coalesce(*found)


def normalize_path(path) -> Column:
    """Resolve ``.`` and ``..`` segments of a slash path."""
    def step(done: Column, segment: Column) -> Column:
        return (
            F.when(segment.isin("", "."), done)
            .when(segment == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.concat(done, F.array(segment)))
        )
    return F.array_join(F.aggregate(F.split(col(path), "/"), F.array().cast("array<string>"), step), "/")


def path_targets(files: DataFrame) -> DataFrame:
    """(repo, key, exact, nearest): each path under all its trailing parts, one row per key."""
    p = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), "/"))
    return files.select(*REPO, "path", F.explode(tails).alias("key")).groupBy(*REPO, "key").agg(
        F.max(F.when(F.col("key") == F.col("path"), F.col("path"))).alias("exact"), F.min("path").alias("nearest"))


def imports(files: DataFrame) -> DataFrame:
    """(repo, from_path, module_name, line, to_path, is_external) of Python and JS/TS files."""
    return python_imports(files).unionByName(script_imports(files))


def python_imports(files: DataFrame) -> DataFrame:
    """A module resolves to an exact path, else one next to the importer, else any path that ends so.

    Leading dots climb from the importer's folder; packages resolve to their ``__init__.py``.
    """
    rows = files.where(F.col("path").endswith(".py")).select(
        *REPO, F.col("path").alias("from_path"), F.posexplode_outer(F.split("text", "\n")).alias("_n", "_l"))
    mod = _first_group(F.trim("_l"), PY_IMPORT, 2)
    rows = rows.select(*REPO, "from_path", (F.col("_n") + 1).alias("line"), mod.alias("module_name")).where(
        F.col("module_name").isNotNull())
    dots = F.length(F.regexp_extract("module_name", r"^\.*", 0))
    folder = paths.parent("from_path")
    tail = F.replace(F.regexp_replace("module_name", r"^\.+", ""), F.lit("."), F.lit("/"))
    above = F.split(folder, "/")
    climbed = F.array_join(F.slice(above, 1, F.greatest(F.size(above) - (dots - 1), F.lit(0))), "/")
    base = F.when(dots > 0, F.concat_ws("/", F.nullif(climbed, F.lit("")), F.nullif(tail, F.lit("")))).otherwise(tail)
    beside = F.when((dots == 0) & (folder != ""), F.concat(folder, F.lit("/"), tail))
    rows = rows.select("*", base.alias("_base"), beside.alias("_beside"), (dots > 0).alias("_relative"))
    target = path_targets(files)

    def look(df: DataFrame, key: Column, name: str) -> DataFrame:
        t = target.select(*REPO, F.col("key").alias(f"_k{name}"), F.col("exact").alias(f"_e{name}"), F.col("nearest").alias(f"_a{name}"))
        return df.withColumn(f"_k{name}", key).join(t, [*REPO, f"_k{name}"], "left")

    rows = look(rows, F.concat("_base", F.lit(".py")), "0")
    rows = look(rows, F.concat("_beside", F.lit(".py")), "1")
    rows = look(rows, F.concat("_base", F.lit("/__init__.py")), "2")
    to = F.coalesce("_e0", "_e1", "_e2", F.when(~F.col("_relative"), F.col("_a0")))
    return rows.select(*REPO, "from_path", "module_name", "line", to.alias("to_path"), to.isNull().alias("is_external"))


def script_imports(files: DataFrame) -> DataFrame:
    """Only dotted specifiers can be internal; they resolve by exact path with the usual endings."""
    src = files.where(paths.suffix("path").isin(*SCRIPT_SUFFIXES))
    one = F.regexp_extract_all("text", F.lit(JS_IMPORT), 1)
    two = F.regexp_extract_all("text", F.lit(JS_IMPORT), 2)
    rows = src.select(*REPO, F.col("path").alias("from_path"), F.posexplode_outer(
        F.zip_with(one, two, lambda a, b: F.when(a != "", a).otherwise(b))).alias("_n", "module_name"))
    rows = rows.where(F.col("module_name").isNotNull())
    base = normalize_path(F.concat_ws("/", paths.parent("from_path"), "module_name"))
    tries = F.when(F.col("module_name").startswith("."), F.transform(
        F.array(*map(F.lit, JS_ENDINGS)), lambda e: F.concat(base, e)))
    known = files.select(*REPO, F.col("path").alias("_try")).distinct()
    wide = rows.select("*", F.posexplode_outer(tries).alias("_p", "_try")).join(
        known.withColumn("_hit", F.lit(True)), [*REPO, "_try"], "left")
    best = wide.groupBy(*REPO, "from_path", "_n", "module_name").agg(
        F.min_by(F.when(F.col("_hit"), F.col("_try")), F.when(F.col("_hit"), F.col("_p"))).alias("to_path"))
    return best.select(*REPO, "from_path", "module_name", F.lit(None).cast("int").alias("line"), "to_path",
                       F.col("to_path").isNull().alias("is_external"))


def import_edges(found: DataFrame, files: DataFrame) -> DataFrame:
    """Internal file-to-file edges, each once per module name."""
    return found.where(~F.col("is_external")).select(*REPO, "from_path", "to_path", "module_name").distinct()


def calls(files: DataFrame) -> DataFrame:
    """(repo, path, caller, callee): distinct intra-file calls between functions the file defines.

    The caller is the nearest definition at or above the call line; definition sites are not calls.
    All of it happens inside the file's row, so nothing moves.
    """
    rows = files.select(*REPO, "path", F.transform(F.split("text", "\n"), lambda l: F.trim(l)).alias("_l"))
    defs = F.filter(F.transform("_l", lambda l, i: F.struct(
        i.alias("at"), F.coalesce(*[F.nullif(F.regexp_extract(l, DEFINITION, g), F.lit("")) for g in (1, 2, 3)]).alias("name"))),
        lambda d: d["name"].isNotNull())
    rows = rows.select(*REPO, "path", "_l", defs.alias("_d"))
    rows = rows.select(*REPO, "path", "_d", F.transform("_d", lambda d: d["name"]).alias("_known"), F.flatten(F.transform(
        "_l", lambda l, i: F.transform(
            F.regexp_extract_all(F.regexp_replace(l, DEFINITION_SITE, " "), F.lit(CALL), F.lit(1)),
            lambda c: F.struct(i.alias("at"), c.alias("callee"))))).alias("_c"))
    inside = F.filter("_c", lambda c: F.array_contains(F.col("_known"), c["callee"]))
    pairs = F.transform(inside, lambda c: F.struct(
        F.element_at(F.filter("_d", lambda d: d["at"] <= c["at"]), -1)["name"].alias("caller"), c["callee"].alias("callee")))
    kept = F.array_distinct(F.filter(pairs, lambda p: p["caller"].isNotNull() & (p["caller"] != p["callee"])))
    found = rows.where(F.size("_known") > 1).select(*REPO, "path", F.explode_outer(kept).alias("_e"))
    return found.where(F.col("_e").isNotNull()).select(
        *REPO, "path", "_e.caller", "_e.callee")


def extends(files: DataFrame) -> DataFrame:
    """(repo, path, child, parent) of single-base classes; module qualifiers are dropped."""
    def pairs(pattern: str) -> Column:
        return F.zip_with(
            F.regexp_extract_all("text", F.lit(pattern), 1), F.regexp_extract_all("text", F.lit(pattern), 2),
            lambda c, p: F.struct(c.alias("child"), F.substring_index(p, ".", -1).alias("parent")))
    found = F.when(F.col("path").endswith(".py"), pairs(PY_CLASS)).when(
        paths.suffix("path").isin(*SCRIPT_SUFFIXES), pairs(JS_CLASS))
    rows = files.select(*REPO, "path", F.explode_outer(F.array_distinct(found)).alias("_e"))
    return rows.where(F.col("_e").isNotNull()).select(
        *REPO, "path", "_e.child", "_e.parent")


def resolve_parents(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Attach the parent's file: the same file first, else the least path of the repository."""
    named = classes.select(*REPO, F.col("class_name").alias("parent"), F.col("path").alias("_at"))
    near = named.groupBy(*REPO, "parent").agg(F.min("_at").alias("_any"))
    same = named.select(*REPO, "parent", F.col("_at").alias("path"), F.lit(True).alias("_same")).distinct()
    out = found.join(same, [*REPO, "parent", "path"], "left").join(near, [*REPO, "parent"], "left")
    return out.select(*REPO, "path", "child", "parent",
                      F.when(F.col("_same"), F.col("path")).otherwise(F.col("_any")).alias("parent_path"))


def test_edges(files: DataFrame) -> DataFrame:
    """(repo, test_path, source_path): least non-test path whose stem the test is named after."""
    p = files.select(*REPO, "path", paths.is_test_path("path").alias("_t"))
    tests = p.where("_t").select(*REPO, F.col("path").alias("test_path"), paths.tested_stem("path").alias("_s"))
    sources = p.where(~F.col("_t")).groupBy(*REPO, paths.stem("path").alias("_s")).agg(F.min("path").alias("source_path"))
    return tests.join(sources, [*REPO, "_s"]).select(*REPO, "test_path", "source_path")


def manifest_packages(manifests: DataFrame) -> DataFrame:
    """(repo, path, name, version, ecosystem) declared by requirements.txt and package.json."""
    base = F.lower(paths.name("path"))
    req = manifests.where(base == "requirements.txt").select(*REPO, "path", F.explode(F.split("text", r"\r?\n")).alias("_l"))
    line = strip("_l")
    version = F.coalesce(F.nullif(F.trim(F.regexp_extract(line, REQUIREMENT, 2)), F.lit("")), F.lit("*"))
    req = req.where((line != "") & ~line.startswith("#") & ~line.startswith("-") & line.rlike(REQUIREMENT)).select(
        *REPO, "path", F.regexp_extract(line, REQUIREMENT, 1).alias("name"), version.alias("version"), F.lit("python").alias("ecosystem"))
    js = manifests.where(base == "package.json").select(*REPO, "path", F.from_json(
        "text", "dependencies map<string,string>, devDependencies map<string,string>").alias("_j"))
    both = F.array_compact(F.array("_j.dependencies", "_j.devDependencies"))
    js = js.select(*REPO, "path", F.explode(both).alias("_m")).select(*REPO, "path", F.explode("_m").alias("name", "version"))
    return req.unionByName(js.select(*REPO, "path", "name", "version", F.lit("npm").alias("ecosystem")))


def package_usage(packages: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Package nodes (last manifest path wins on version) and their USED_BY edges to modules."""
    with_id = packages.withColumn("package_id", F.concat_ws(":", F.lit("package"), "ecosystem", "name"))
    nodes = with_id.groupBy(*REPO, "package_id", "name", "ecosystem").agg(F.max_by("version", F.struct("path", "version")).alias("version"))
    used = with_id.join(files.select(*REPO, "path", "module_id"), [*REPO, "path"]).select(
        *REPO, "package_id", "module_id", F.col("path").alias("declared_in")).distinct()
    return nodes, used


def co_located_documents(documents: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, doc_path, symbol_id, confidence 0.8): same folder and same lower-cased stem."""
    key = lambda p: [paths.parent(p).alias("_dir"), F.lower(paths.stem(p)).alias("_stem")]
    d = documents.select(*REPO, F.col("path").alias("doc_path"), *key("path"))
    s = symbols.select(*REPO, "symbol_id", *key("path"))
    return d.join(s, [*REPO, "_dir", "_stem"]).select(*REPO, "doc_path", "symbol_id", F.lit(0.8).alias("confidence"))


def link_tokens(path) -> Column:
    """Words of a relative path that may name a module: four letters or more and no stop words."""
    flat = F.replace(F.replace(col(path), F.lit("\\"), F.lit("/")), F.lit("/"), F.lit("_"))
    words = F.split(F.lower(paths.stem(flat)), r"[_\-.\s]+")
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) >= 4) & ~t.isin(*MODULE_STOP_TOKENS)))


def link_documents_to_modules(documents: DataFrame, modules: DataFrame) -> DataFrame:
    """(organization_id, doc_id, module_id): module with the longest path that contains a path word.

    Whole-word containment is an equality between the document's words and the module's words, so
    it runs as a hash join; a word contributes only its best module to it.
    """
    words = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "module_name", "module_path")), r"\W+"))
    by_word = modules.select("organization_id", "module_id", "module_name", "module_path", F.explode(words).alias("_w"))
    by_word = by_word.groupBy("organization_id", "_w").agg(
        F.min(F.struct((-F.length("module_path")).alias("l"), F.col("module_name").alias("n"), F.col("module_id").alias("id"))).alias("_best"))
    tokens_ = documents.select("organization_id", "doc_id", F.explode_outer(link_tokens("relative_path")).alias("_w"))
    return tokens_.join(by_word, ["organization_id", "_w"]).groupBy("organization_id", "doc_id").agg(
        F.min("_best").alias("_b")).select("organization_id", "doc_id", F.col("_b.id").alias("module_id"))
