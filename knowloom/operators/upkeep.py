"""Ingest semantics: upsert, delete, versions, content dedup, run ledger, summaries, walk and inventory."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from .retrieval import top_k

ORG = "organization_id"

# Kinds of documents that may be uploaded.
UPLOAD_SUFFIXES = (".md", ".txt", ".rst", ".pdf", ".docx")


def tenant(df: DataFrame, organization_id: str) -> DataFrame:
    """The rows of one tenant; there is no way to ask for all of them."""
    if not (organization_id or "").strip():
        raise ValueError("organization_id is required")
    return df.where(F.col(ORG) == organization_id.strip())


def append_new(current: DataFrame, added: DataFrame, key: list[str]) -> DataFrame:
    """Collection add: rows whose id exists already are not overwritten; within the batch the first wins."""
    return current.unionByName(added.dropDuplicates(key).join(current.select(*key), key, "left_anti"))


def delete_where(current: DataFrame, condition: Column) -> DataFrame:
    """Collection delete: rows for which the condition is unknown stay."""
    return current.where(~F.coalesce(condition, F.lit(False)))


def upsert_nodes(current: DataFrame, incoming: DataFrame, key: list[str], version: str) -> DataFrame:
    """Insert or replace by key: the row with the latest ``version`` stays.

    One aggregation with map-side combine; no ordering of a key's rows takes place.
    """
    both = current.unionByName(incoming)
    rest = [c for c in both.columns if c not in (*key, version)]
    return both.groupBy(*key).agg(F.max(F.struct(version, *rest)).alias("_row")).select(*key, "_row.*")


def upsert_edges(edges: DataFrame, nodes: DataFrame, identity: list[str]) -> DataFrame:
    """Edges with both ends present, each identity once."""
    ids = nodes.select(ORG, F.col("id").alias("_id")).distinct()
    kept = edges.join(ids.withColumnRenamed("_id", "source"), [ORG, "source"], "left_semi").join(
        ids.withColumnRenamed("_id", "target"), [ORG, "target"], "left_semi")
    return kept.dropDuplicates([ORG, *identity])


def detach_delete(nodes: DataFrame, edges: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove nodes and every edge that touches them."""
    d = doomed.select(ORG, "id").distinct()
    left = nodes.join(d, [ORG, "id"], "left_anti")
    rest = edges.join(d.withColumnRenamed("id", "source"), [ORG, "source"], "left_anti").join(
        d.withColumnRenamed("id", "target"), [ORG, "target"], "left_anti")
    return left, rest


def duplicate_keys(nodes: DataFrame, key: list[str]) -> DataFrame:
    """Violations of a uniqueness rule: keys that occur more than once."""
    return nodes.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def assign_versions(incoming: DataFrame, prior: DataFrame, key: list[str]) -> DataFrame:
    """Same hash keeps the prior version (at least 1), another hash adds one, a new document starts at 1."""
    p = prior.select(*key, F.col("content_hash").alias("_h"), F.col("version").alias("_v"))
    v = F.when(F.col("_v").isNull(), 1).when(F.col("_h") == F.col("content_hash"), F.greatest("_v", F.lit(1))).otherwise(F.col("_v") + 1)
    state = F.when(F.col("_v").isNull(), "new").when(F.col("_h") == F.col("content_hash"), "unchanged").otherwise("changed")
    return incoming.join(p, key, "left").withColumns({"version": v.cast("int"), "state": state}).drop("_h", "_v")


def reingest(incoming: DataFrame, prior: DataFrame, chunks: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Documents to write (new and changed) and the chunk table without the chunks of changed ones."""
    versioned = assign_versions(incoming, prior, key)
    changed = versioned.where(F.col("state") == "changed").select(*key)
    return versioned.where(F.col("state") != "unchanged"), chunks.join(changed, key, "left_anti")


def first_copies(documents: DataFrame, key: list[str], order: str) -> DataFrame:
    """Flag each document as the first of its (key, content) or a repeat of it.

    The smallest ``order`` per content is found by a combining aggregation and joined back on the
    document id, so a heavily copied text never gathers in one task.
    """
    firsts = documents.groupBy(*key, "content_hash").agg(F.min(order).alias(order)).withColumn("_first", F.lit(True))
    return documents.join(firsts, [*key, "content_hash", order], "left").withColumn(
        "is_copy", ~F.coalesce("_first", F.lit(False))).drop("_first")


# ------------------------------------------------------------------ run ledger


def latest_states(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last state per task."""
    rest = [c for c in events.columns if c not in (key, *order)]
    return events.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_e")).select(key, "_e.*")


def recover_stale(states: DataFrame, active: list[str], now: Column, minutes: int) -> DataFrame:
    """Active tasks not updated for ``minutes`` become failed, with the reason."""
    stale = F.col("status").isin(*active) & (F.col("updated_at") < now - F.expr(f"INTERVAL {int(minutes)} MINUTES"))
    return states.withColumns({
        "status": F.when(stale, "failed").otherwise(F.col("status")),
        "error": F.when(stale, F.lit("interrupted"))})


def run_listing(states: DataFrame, limit: int) -> DataFrame:
    """Newest runs of every tenant with completed and total document counts."""
    done = F.size(F.filter("documents", lambda d: d["status"] == "completed"))
    rows = states.withColumns({"documents_completed": done, "documents_total": F.size("documents")})
    return top_k(rows, [ORG], [F.desc("updated_at"), F.asc("task_id")], limit, "position").drop("documents")


def status_ladder(failed: Column, embedded: Column | None = None) -> Column:
    """Status of a run: failed, completed without a single embedded chunk, or completed."""
    status = F.when(failed, "failed")
    return (status if embedded is None else status.when(embedded == 0, "completed_without_embeddings")).otherwise("completed")


# ------------------------------------------------------------------ walks


def walk_problem(path, size, max_bytes: int | None = None) -> Column:
    """Why the ingestion walk leaves a file out; null for a kept one. Files are too large only beyond a given ``max_bytes``."""
    p = paths.parts(F.col(path))
    folders = F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))
    ext = F.lower(paths.suffix(F.col(path)))
    return (
        F.when(F.exists(folders, lambda d: d.isin(*paths.WALK_SKIP_FOLDERS) | d.startswith(".")), "skipped_folder")
        .when(ext.isin(*paths.WALK_SKIP_SUFFIXES), "skipped_suffix")
        .when(~ext.isin(*paths.CODE_SUFFIXES, *paths.DOC_SUFFIXES), "unsupported")
        .when(_above(size, max_bytes), "too_large")
    )


def _above(size, ceiling: int | None) -> Column:
    return F.lit(False) if ceiling is None else F.col(size) > ceiling


def ingestion_walk(files: DataFrame, max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Kept files of every repository in path order, marked as document or code; all of them unless ceilings are given."""
    kept = files.where(walk_problem("path", "size_bytes", max_bytes).isNull())
    ranked = top_k(kept, [ORG, "repository_id"], [F.asc("path")], max_files, "position")
    return ranked.withColumns({"is_document": paths.is_document("path"), "module_name": paths.module_of("path")})


def inventory_reason(path, size, sample_has_nul, max_file_bytes: int | None = None) -> Column:
    """Exclusion reason of the source inventory before the size budget; null for a candidate."""
    p = paths.parts(F.col(path))
    folders = F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))
    return (
        F.when(F.exists(folders, lambda d: F.lower(d).isin(*paths.INVENTORY_SKIP_FOLDERS)), "generated_or_vendor_directory")
        .when(paths.is_sensitive(F.col(path)), "sensitive_file")
        .when(~paths.is_recognized_text(F.col(path)), "binary_or_unsupported")
        .when(_above(size, max_file_bytes), "file_size_limit")
        .when(F.col(sample_has_nul), "binary_or_unsupported")
    )


def source_inventory(files: DataFrame, max_bytes: int | None = None, max_files: int | None = None, max_file_bytes: int | None = None) -> DataFrame:
    """Every file with its category, language and exclusion reason.

    Nothing is cut unless a ceiling is given.  The file cap is a rank cut.  The byte budget is greedy in
    walk order (a file that does not fit is passed over, later smaller ones may fit); that needs the
    order, so the candidates of one repository, path and size only, are walked in a task of their own.
    """
    keys = [ORG, "repository_id"]
    marked = files.withColumns({
        "reason": inventory_reason("path", "size_bytes", "has_nul", max_file_bytes), "category": paths.category("path"), "language": paths.language("path")})
    if max_bytes is None and max_files is None:
        return marked
    ranked = marked.withColumn("_walk", walk_order("path"))
    pool = top_k(ranked.where(F.coalesce(F.col("reason") != "generated_or_vendor_directory", F.lit(True))), keys, [F.asc("_walk")], max_files, "_n")
    pool = pool.select(*keys, "path", F.lit(True).alias("_in"))
    marked = ranked.join(pool, [*keys, "path"], "left").withColumn(
        "reason", F.coalesce(F.when(F.col("_in").isNull() & (F.coalesce(F.col("reason"), F.lit("")) != "generated_or_vendor_directory"),
                                    F.lit("repository_file_limit")), F.col("reason")))
    if max_bytes is None:
        return marked.drop("_in", "_walk")
    candidates = marked.where(F.col("reason").isNull())
    # repositories that fit as a whole need no walk at all
    totals = candidates.groupBy(*keys).agg(F.sum("size_bytes").alias("_sum")).where(F.col("_sum") > max_bytes).select(*keys)
    over = candidates.join(totals, keys, "left_semi").select(*keys, "path", "size_bytes", "_walk")

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        used, out = 0, []
        for path, size in rows.sort_values("_walk")[["path", "size_bytes"]].itertuples(index=False):
            if used + size > max_bytes:
                out.append(path)
            else:
                used += size
        picked = pd.DataFrame({"path": out})
        for k in keys:
            picked[k] = rows[k].iloc[0]
        return picked[[*keys, "path"]]

    dropped = over.groupBy(*keys).applyInPandas(greedy, f"{ORG} string, repository_id string, path string").withColumn("_budget", F.lit(True))
    out = marked.join(dropped, [*keys, "path"], "left")
    return out.withColumn("reason", F.coalesce("reason", F.when(F.col("_budget"), F.lit("repository_size_limit")))).drop("_in", "_budget", "_walk")


def walk_order(path) -> Column:
    """Sort key of a top-down walk: the files of a folder come before its subfolders."""
    p = paths.parts(F.col(path))
    return F.array_join(F.transform(p, lambda s, i: F.concat(F.when(i == F.size(p) - 1, F.lit("\x01")).otherwise(F.lit("\x02")), s)), "\x00")


def inventory_histograms(inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    kept = inventory.where(F.col("reason").isNull())
    langs = kept.where(F.col("language").isNotNull()).groupBy(ORG, "language").agg(F.count(F.lit(1)).alias("files"))
    cats = kept.groupBy(ORG, "category").agg(F.count(F.lit(1)).alias("files"))
    return langs, cats


def upload_problem(path, size, max_bytes: int | None = None) -> Column:
    """Why an uploaded document is refused; null for an accepted one. Any size is accepted unless a caller says otherwise."""
    large = F.lit(False) if max_bytes is None else F.col(size) > max_bytes
    p = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
    return (
        F.when(p.startswith("/") | F.array_contains(F.split(p, "/"), ".."), "unsafe_path")
        .when(~F.lower(paths.suffix(p)).isin(*UPLOAD_SUFFIXES), "unsupported_type")
        .when(large, "too_large")
    )


def ingestion_summary(outcomes: DataFrame, keys: list[str], embedded: str | None = None) -> DataFrame:
    """Counts per run and the run status; ``embedded`` names a column with the number of embedded chunks of each document."""
    n = lambda state: F.count_if(F.col("state") == state)
    rows = outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("documents_total"), n("new").alias("documents_new"), n("changed").alias("documents_changed"),
        n("unchanged").alias("documents_skipped"), F.count_if(F.col("failed")).alias("documents_failed"),
        *([] if embedded is None else [F.sum(F.coalesce(embedded, F.lit(0))).alias("chunks_embedded")]))
    failed = F.col("documents_failed") == F.col("documents_total")
    return rows.withColumn("status", status_ladder(failed, None if embedded is None else F.col("chunks_embedded")))
