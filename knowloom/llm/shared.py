"""Helpers of the operators in this package: staged tables, connected components, union-find on arrays."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bits of the map of rows that a few keys may touch; two megabytes are sent to every task.
BITS = 1 << 24


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where that is unset, a temporary one in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        named = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts lineage for iterative work and spares a second run of Python code where two branches read
    the same rows. Survives the loss of any executor.
    """
    path = f"{shared_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return freed memory of this worker to the system: workers are reused, and what one task has freed counts against the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows and ``size`` bytes (one row at least), so that only one piece is Python objects at a time."""
    give_back()
    for batch in batches:
        low = 0
        while low < batch.num_rows:
            part = batch.slice(low, rows)
            while part.num_rows > 1 and part.nbytes > size:
                part = part.slice(0, part.num_rows // 2)
            yield part
            low += part.num_rows
        give_back()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_1``, ``name_2`` ... that no column of ``df`` has (Spark ignores case)."""
    taken, k = {c.lower() for c in df.columns}, 0
    while (out := name if not k else f"{name}_{k}").lower() in taken:
        k += 1
    return out


def marked(rows: DataFrame, own: Column, keys: DataFrame, key: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: whether their ``own`` hash may be among the ``key`` hashes of ``keys``; never false for one that is.

    The hashes become a bitmap of at most BITS / 32768 rows of 4 KiB, whatever their number, so rows stay where they are read.
    Where the map fills up, more rows are marked that meet no key.
    """
    place = lambda h: F.pmod(h, F.lit(BITS)) + 1
    placed = keys.select(place(key).alias("p"))
    number, bits, at = (free_name(rows, n) for n in ("bitmap_bucket", "bitmap_bits", "bitmap_place"))
    held = placed.groupBy(F.bitmap_bucket_number("p").alias(number)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias(bits))
    met = rows.withColumn(at, place(own)).join(F.broadcast(held), F.bitmap_bucket_number(at) == F.col(number), "left")
    position = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return met.select(*rows.columns, F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False)).alias(name))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges ``(node, smallest node of its component)`` that connect what the edges ``a``-``b`` connect."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for side in (x, y):
            np.minimum.at(new, side, low)
            np.minimum.at(new, root[side], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (columns ``a``, ``b`` of one type with an order): ``id``, ``component`` (smallest id).

    Alternates large-star and small-star steps until the edges no longer change. A step is a minimum
    per node with map-side combine and a join of the edges with those minima, which adaptive
    execution can split at a hot node; the number of edges never grows. Every round is written to
    the shared folder. Nodes without an edge to another node are not in the result.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = staged(e, "edges")
    seen = _mark(e)
    while seen[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = staged(small.where("u <> v").distinct(), "edges")
        now = _mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _mark(e: DataFrame) -> tuple[int, int]:
    row = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x
