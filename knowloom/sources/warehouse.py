"""The given tables seen as the entity model: tenants, repositories, files, symbols, commits, chunks.

Every frame here is a projection or an aggregation of the parquet tables, so its size follows theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import paths
from ..operators import chunking
from ..session import spread

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------ text corpus


def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents"))
    return d.select(
        F.col("lang").alias("organization_id"), F.concat(F.lit("repo:"), "source").alias("repository_id"),
        F.col("doc_id").alias("source_id"), F.col("doc_id").cast("string").alias("doc_id"),
        F.concat("source", F.lit("_"), "doc_id", F.lit(".txt")).alias("filename"), "text",
    )


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_window_chunks(corpus_documents(spark, sf_dir))


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("source_id"), "embedding")


def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_chunks(spark, sf_dir).join(document_vectors(spark, sf_dir), "source_id")


def tenants(spark: SparkSession, sf_dir: str) -> list[str]:
    """The tenants of the document corpus, a handful of names."""
    rows = table(spark, sf_dir, "documents").where("lang is not null").select("lang").distinct().collect()
    return sorted(r.lang for r in rows)


def tenant_queries(spark: SparkSession, sf_dir: str, with_vectors: bool = False) -> DataFrame:
    """Every benchmark text asked in every tenant that has a document."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    if with_vectors:
        q = q.join(document_vectors(spark, sf_dir).withColumnRenamed("source_id", "query_id"), "query_id")
    return q.withColumn("organization_id", F.explode(F.array(*map(F.lit, tenants(spark, sf_dir)))))


# ------------------------------------------------------------ code graph


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> files: tenant by type, repository by brand, folder from the first word of the name."""
    p = table(spark, sf_dir, "part")
    ext = F.element_at(F.array(*map(F.lit, (".py", ".ts", ".md", ".json", ".java"))), (F.col("p_size") % 5 + 1).cast("int"))
    first, second = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    base = F.concat(second, F.lit("_"), F.col("p_partkey").cast("string"), ext)
    path = F.when(F.col("p_partkey") % 10 == 0, base).otherwise(F.concat(first, F.lit("/"), base))
    repo = F.concat(F.lit("repo:"), F.lower("p_brand"))
    out = p.select("p_partkey", F.col("p_type").alias("organization_id"), repo.alias("repository_id"), path.alias("path"), "p_size")
    return out.select(
        "organization_id", "repository_id", "path", "p_partkey",
        F.concat("repository_id", F.lit(":module:"), paths.module_of("path")).alias("module_id"),
        paths.module_of("path").alias("module_name"),
        F.concat("repository_id", F.lit(":file:"), "path").alias("file_id"),
        paths.language("path").alias("language"), (F.col("p_size") * 20).cast("int").alias("loc"),
    )


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> symbol occurrences inside files (names repeat within a file, as in real code)."""
    li = table(spark, sf_dir, "lineitem")
    occ = li.select(
        F.col("l_partkey").alias("p_partkey"),
        F.concat(F.lit("fn_"), "l_linenumber", F.lit("_"), (F.col("l_suppkey") % 50).cast("string")).alias("function_name"),
        F.when(F.col("l_linestatus") == "O", F.concat(F.lit("Cls"), F.col("l_linenumber").cast("string"))).otherwise("").alias("parent_class"),
        (F.col("l_orderkey") % 1000 + 1).cast("int").alias("start_line"),
        (F.col("l_orderkey") % 1000 + 1 + F.col("l_quantity")).cast("int").alias("end_line"),
        (F.col("l_quantity") * 8).cast("int").alias("token_count"),
        (F.col("l_returnflag") == "R").alias("is_documented"),
    )
    # by the size of their packed columns files look small enough to broadcast; they grow with the symbols
    return occ.join(files(spark, sf_dir).hint("merge"), "p_partkey").withColumn("function_id", F.concat("file_id", F.lit("::"), "function_name"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem x supplier -> (author, path, time) touch rows."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    f = files(spark, sf_dir).hint("merge")  # as in functions
    return (
        li.join(s, li["l_suppkey"] == s["s_suppkey"]).join(f, li["l_partkey"] == f["p_partkey"])
        .select(
            "organization_id", "repository_id", "module_id", "module_name", "file_id", "path", "p_partkey",
            F.format_string("%08d-%d", "l_orderkey", "l_linenumber").alias("sha"), F.col("s_name").alias("author_name"),
            F.concat(F.replace("s_name", F.lit("#"), F.lit(".")), F.lit("@Example.com")).alias("author_email"),
            F.col("l_shipdate").cast("timestamp").alias("committed_at"),
        )
    )


def linked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> documents linked to the module of the file with the same key."""
    c = table(spark, sf_dir, "customer")
    f = files(spark, sf_dir)
    names = {"BUILDING": "README.md", "MACHINERY": "package.json", "AUTOMOBILE": "CONTRIBUTING.md", "HOUSEHOLD": "guide.md"}
    filename = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("c_mktsegment")), F.lit("notes.txt"))
    return c.join(f, c["c_custkey"] == f["p_partkey"]).select(
        "organization_id", "repository_id", "module_id", "module_name",
        F.concat(F.lit("doc:"), "c_name").alias("doc_id"), filename.alias("filename"),
        F.concat("module_name", F.lit("/"), F.lower("c_name"), F.lit("/"), filename).alias("relative_path"),
        (F.col("c_nationkey") % 3 + 1).cast("int").alias("version"),
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One function per (file, name), with both naming styles the operators use."""
    from ..operators.health import first_symbols

    f = first_symbols(functions(spark, sf_dir))
    return f.withColumns({"symbol_id": F.col("function_id"), "symbol_name": F.col("function_name")})


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = functions(spark, sf_dir).where(F.col("parent_class") != "")
    keys = ["organization_id", "repository_id", "module_id", "module_name", "file_id", "path"]
    c = occ.groupBy(*keys, F.col("parent_class").alias("symbol_name")).agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    return c.withColumn("symbol_id", F.concat("file_id", F.lit("::"), "symbol_name"))


def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.health import ownership as owns

    return owns(commits(spark, sf_dir))


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("organization_id", "repository_id", "module_id", "module_name").distinct().withColumn(
        "module_path", F.col("module_name"))


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fn_n_s calls fn_{n+1}_s of the same file."""
    s = symbols(spark, sf_dir).select("organization_id", "repository_id", "file_id", "path", "function_name", "function_id")
    n = F.split("function_name", "_")
    nxt = F.concat(F.lit("fn_"), (n[1].cast("int") + 1).cast("string"), F.lit("_"), n[2])
    callee = s.select(F.col("function_id").alias("target"), F.col("function_name").alias("callee"))
    return s.withColumn("target", F.concat("file_id", F.lit("::"), nxt)).join(callee, "target").select(
        "organization_id", "repository_id", "file_id", "path", F.col("function_name").alias("caller"), "callee",
        F.col("function_id").alias("source"), "target", F.lit("CALLS").alias("type"))


def import_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file imports the file with the next key when that is in the same tenant."""
    f = files(spark, sf_dir).select("organization_id", "p_partkey", "file_id")
    t = f.select("organization_id", (F.col("p_partkey") - 1).alias("p_partkey"), F.col("file_id").alias("target"))
    return f.join(t, ["organization_id", "p_partkey"]).select("organization_id", F.col("file_id").alias("source"), "target", F.lit("IMPORTS").alias("type"))


def trade_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier nation -> customer nation per order line: repeated links with self links, per region of the supplier."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(s, li["l_suppkey"] == s["s_suppkey"]).join(
        n, s["s_nationkey"] == n["n_nationkey"])
    # combine equal links before they move
    return rows.groupBy(F.concat(F.lit("org"), "n_regionkey").alias("organization_id"), F.col("s_nationkey").cast("string").alias("source"),
                        F.col("c_nationkey").cast("string").alias("target")).agg(F.count(F.lit(1)).alias("evidence_count")).withColumn("type", F.lit("SHIPS"))
