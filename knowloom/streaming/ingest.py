"""File-drop ingestion: new documents are versioned by content hash and chunked as they arrive."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import paths
from ..functions.text import content_hash
from ..operators import upkeep
from ..operators.headings import chunk_documents
from ..sources.files import clean_utf8

KEY = ["organization_id", "doc_id"]
UNREADABLE = (".docx", ".pdf")  # accepted kinds that are no plain text; they go through ``sources.files`` first
VERSIONS = "organization_id string, doc_id string, content_hash string, version int"


def dropped_documents(spark: SparkSession, folder: str, organization_id: str, deliveries: bool = False, max_bytes: int | None = None) -> DataFrame:
    """Stream of all documents put into ``folder``; one that cannot be taken has a ``reason`` and no text.

    A stream reads each file once, also if it is overwritten later. With ``deliveries`` the folders right below
    ``folder`` name deliveries and are no part of a document's path, so a later delivery brings new versions.
    Documents over ``max_bytes`` are refused where a caller sets it.
    """
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option(
        "recursiveFileLookup", "true").load(folder)
    ext = F.lower(paths.suffix("path"))
    reason = F.coalesce(upkeep.upload_problem("relative_path", "length", max_bytes), F.when(ext.isin(*UNREADABLE), "needs_a_reader"))
    # A document is its path below the folder, so files of one name in two folders are two documents.
    below = relative_path("path", folder)
    named = raw.withColumn("relative_path", F.regexp_replace(below, "^[^/]+/", "") if deliveries else below).withColumn("reason", reason)
    return named.select(
        F.lit(organization_id).alias("organization_id"), F.concat(F.lit("doc:"), "relative_path").alias("doc_id"), paths.name("path").alias("filename"),
        F.when(F.col("reason").isNull(), clean_utf8("content")).alias("text"), F.when(ext == ".md", "heading_aware").otherwise("fixed_window").alias("chunking_method"), "reason", "modificationTime")


def relative_path(path: str, folder: str) -> Column:
    """The part of a file's address below ``folder``, whatever scheme either is written with."""
    root = re.sub(r"^[A-Za-z][\w+.-]*:/*", "/", folder).rstrip("/") + "/"
    plain = F.regexp_replace(F.url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B"))), r"^[A-Za-z][\w+.-]*:/*", "/")
    at = F.instr(plain, root)
    return F.when(at > 0, F.substr(plain, at + len(root))).otherwise(plain)


def ingest(stream: DataFrame, tables: str, checkpoint: str) -> StreamingQuery:
    """Keep ``tables``/versions, ``tables``/chunks and ``tables``/refused up to date, one committed folder per batch.

    A batch replaces its own folders, so a replay after a lost executor or a restart writes the same
    rows again instead of adding them twice.  Readers take the latest version per document.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        refused = batch.where("reason is not null").select(*KEY, "filename", "reason", "modificationTime")
        refused.write.mode("overwrite").parquet(f"{tables}/refused/batch_id={batch_id}")
        taken = batch.where("reason is null").drop("reason")
        newest = upkeep.upsert_nodes(taken.limit(0), taken, KEY, "modificationTime")
        docs = newest.withColumn("content_hash", content_hash("text", 32))
        prior = known_versions(spark, tables, before=batch_id)
        changed = upkeep.assign_versions(docs, prior, KEY).where(F.col("state") != "unchanged").persist()
        changed.select(*KEY, "content_hash", "version").write.mode("overwrite").parquet(f"{tables}/versions/batch_id={batch_id}")
        chunk_documents(changed.select(*KEY, "filename", "text", "chunking_method", "version")).select(
            *KEY, "version", "chunk_id", "chunk_index", "text", "content_hash").write.mode("overwrite").parquet(f"{tables}/chunks/batch_id={batch_id}")
        changed.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def known_versions(spark: SparkSession, tables: str, before: int | None = None) -> DataFrame:
    """Latest version per document, optionally as it was before a batch."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{tables}/versions")
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], VERSIONS)
    rows = spark.read.schema(VERSIONS + ", batch_id long").option("basePath", f"{tables}/versions").parquet(f"{tables}/versions")
    if before is not None:
        rows = rows.where(F.col("batch_id") < before)
    return rows.groupBy(*KEY).agg(
        F.max(F.struct("version", "content_hash")).alias("_v")).select(*KEY, F.col("_v.content_hash").alias("content_hash"), F.col("_v.version").alias("version"))


def current_chunks(spark: SparkSession, tables: str) -> DataFrame:
    """Chunks of the latest version of every document."""
    chunks = spark.read.option("basePath", f"{tables}/chunks").parquet(f"{tables}/chunks")
    return chunks.join(known_versions(spark, tables).select(*KEY, "version"), [*KEY, "version"], "left_semi")
