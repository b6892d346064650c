"""Exact nearest neighbours from cells with radii, for any number of questions in one plan.

Vectors stay where they are read: a segment is what lies of one scope in one piece of an Arrow batch, cut into cells around
some of its vectors. The table of cells (center, radius, size) is small. A first step over it alone bounds the distance of
each question's k-th neighbour from above: the cells that lie within that distance hold k vectors. A second step takes the
vectors, and of each segment only the cells whose nearest possible point is within the bound. Questions travel in blocks
of bounded size; every segment gives up k rows a question.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import staged

#: Vectors of a cell on average, bytes of a segment's vectors, and questions of one scope that travel together.
CELL, SEGMENT_BYTES, QUESTIONS = 128, 8_000_000, 2_000
#: Distances are rounded to six places, so bounds are compared with this much to spare, for each unit of length.
SPARE = 1e-5


@dataclass
class VectorCells:
    """``segments``: scope, segment, dimensions, ``cells`` (centers, then radii, then sizes), ``vectors`` in the order of the cells, ``chunk_ids``."""

    scope: list[str]
    segments: DataFrame


def _square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T, 0.0)


def _cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Centers, radii and sizes of the cells of some vectors, and the order that puts each cell's vectors together."""
    many = max(1, len(data) // CELL)
    centers = data[np.linspace(0, len(data) - 1, many).astype(int)]
    own = _square_distances(data, centers).argmin(axis=1)
    order = np.argsort(own, kind="stable")
    used, begin, sizes = np.unique(own[order], return_index=True, return_counts=True)
    gap = np.sqrt(((data[order] - centers[own[order]]) ** 2).sum(1))
    return centers[used], np.maximum.reduceat(gap, begin), sizes, order


def build(chunks: DataFrame, scope: list[str] = ["organization_id"]) -> VectorCells:
    """Segments of all ``chunks`` (scope columns, chunk_id, embedding) that have a vector, written once to the shared folder."""
    read = chunks.where(F.size("embedding") > 0).select(*scope, F.col("chunk_id").cast("string").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    n = len(scope)
    fields = "segment long, dimensions int, cells binary, vectors binary, chunk_ids array<string>"
    schema = T.StructType([read.schema[c] for c in scope] + T._parse_datatype_string(fields).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            groups: dict[tuple, list[int]] = {}
            sizes = np.diff(batch.column(n + 1).offsets.to_numpy())
            for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(n)), sizes.tolist())):
                groups.setdefault(key, []).append(k)
            for (*key, dim), rows in groups.items():
                for low in range(0, len(rows), max(1, SEGMENT_BYTES // (8 * max(1, dim)))):
                    own = batch.take(pa.array(rows[low : low + max(1, SEGMENT_BYTES // (8 * max(1, dim)))]))
                    data = own.column(n + 1).flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, dim)
                    centers, radii, counts, order = _cut(data)
                    ids = own.column(n).take(pa.array(order)).to_pylist()
                    cells = np.concatenate([centers.ravel(), radii, counts.astype(np.float64)]).tobytes()
                    made = [[number], [dim], [cells], [data[order].tobytes()], [ids]]
                    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.string())]
                    keys = [pa.array([value], batch.schema.field(c).type) for c, value in enumerate(key)]
                    yield pa.RecordBatch.from_arrays([*keys, *[pa.array(v, kind) for v, kind in zip(made, kinds)]], names=schema.names)
                    number += 1

    return VectorCells(list(scope), staged(read.mapInArrow(run, schema)))


def _blocks(asked: DataFrame, scope: list[str], *more: str) -> DataFrame:
    """Questions of a scope and dimension in blocks of about QUESTIONS: one row a block."""
    sized = asked.groupBy(*scope, "dimensions").agg(F.ceil(F.count("*") / QUESTIONS).cast("int").alias("_blocks"))
    dealt = asked.join(sized, [*scope, "dimensions"]).withColumn("_block", F.pmod(F.xxhash64("query_id"), "_blocks"))
    return dealt.groupBy(*scope, "dimensions", "_block").agg(F.collect_list(F.struct("query_id", "embedding", *more)).alias("asked")).drop("_block")


def _cells(data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = np.frombuffer(data, np.float64)
    many = len(flat) // (dim + 2)
    return flat[: many * dim].reshape(many, dim), flat[many * dim : many * (dim + 1)], flat[many * (dim + 1) :].astype(np.int64)


def _least(cost: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` least costs, ties by ``order``."""
    near = np.arange(len(cost))
    if len(near) > k:
        near = np.flatnonzero(cost <= np.partition(cost, k - 1)[k - 1])
    return near[np.lexsort((order[near], cost[near]))][:k]


def nearest(index: VectorCells, queries: DataFrame, k: int) -> DataFrame:
    """(scope, query_id, chunk_id, distance): of each segment the ``k`` nearest chunks of every query (scope, query_id, embedding) that can be among the ``k`` nearest of all."""
    scope, n = index.scope, len(index.scope)
    asked = queries.where(F.size("embedding") > 0).select(*scope, "query_id", F.col("embedding").cast("array<double>").alias("embedding")).withColumn("dimensions", F.size("embedding"))
    query_type = queries.schema["query_id"].dataType
    named = [index.segments.schema[c] for c in scope]
    bound_schema = T.StructType([*named, T.StructField("query_id", query_type), T.StructField("reach", T.DoubleType()), T.StructField("held", T.LongType())])
    near_schema = T.StructType([*named, T.StructField("query_id", query_type), T.StructField("chunk_id", T.StringType()), T.StructField("distance", T.DoubleType())])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], pa.StructArray, np.ndarray, dict]]:
        """A segment and a block of questions at a time: the scope, the questions, their matrix, and the segment."""
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                block = row.column("asked").flatten()
                matrix = block.field("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(block), -1)
                yield [row.column(c) for c in range(n)], block, matrix, row

    def made(schema: T.StructType, keys: list[pa.Array], block: pa.StructArray, which: np.ndarray, *columns: pa.Array) -> pa.RecordBatch:
        first = pa.array(np.zeros(len(which), np.int64))
        return pa.RecordBatch.from_arrays([*[c.take(first) for c in keys], block.field("query_id").take(pa.array(which)), *columns], names=schema.names)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, block, matrix, row in rows_of(batches):
            centers, radii, sizes = _cells(row.column("cells")[0].as_py(), matrix.shape[1])
            reach = np.sqrt(_square_distances(matrix, centers)) + radii[None, :]
            order = np.argsort(reach, axis=1)
            held = np.cumsum(sizes[order], axis=1)
            which, where = np.nonzero(np.concatenate([np.zeros((len(matrix), 1)), held[:, :-1]], axis=1) < k)
            at = order[which, where]
            yield made(bound_schema, keys, block, which, pa.array(reach[which, at]), pa.array(sizes[at]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, block, matrix, row in rows_of(batches):
            dim = matrix.shape[1]
            centers, radii, sizes = _cells(row.column("cells")[0].as_py(), dim)
            ids = np.array(row.column("chunk_ids")[0].as_py(), object)
            data = np.frombuffer(row.column("vectors")[0].as_py(), np.float64).reshape(len(ids), dim)
            order = np.empty(len(ids), np.int64)
            order[np.argsort(ids, kind="stable")] = np.arange(len(ids))
            reach = block.field("reach").to_numpy(zero_copy_only=False)
            spare = SPARE * (1 + np.sqrt(max((data * data).sum(1).max(), (matrix * matrix).sum(1).max())))
            open_ = np.sqrt(_square_distances(matrix, centers)) - radii[None, :] <= reach[:, None] + spare
            cell = np.repeat(np.arange(len(sizes)), sizes)
            which, where, far = [], [], []
            for low in range(0, len(matrix), 64):
                part = open_[low : low + 64]
                seen = np.flatnonzero(part.any(axis=0)[cell])
                if not len(seen):
                    continue
                cost = np.round(_square_distances(matrix[low : low + 64], data[seen]), 6)
                for i, values in enumerate(cost):
                    near = _least(values, order[seen], k)
                    near = near[values[near] <= reach[low + i] ** 2 + spare * (1 + 2 * reach[low + i])]
                    which.append(np.full(len(near), low + i))
                    where.append(seen[near])
                    far.append(values[near])
            if which:
                yield made(near_schema, keys, block, np.concatenate(which), pa.array(ids[np.concatenate(where)], pa.string()), pa.array(np.concatenate(far)))

    small = index.segments.select(*scope, "dimensions", "cells")
    reached = small.join(_blocks(asked, scope), [*scope, "dimensions"]).select(*scope, "cells", "asked").mapInArrow(bounds, bound_schema)
    along = Window.partitionBy(*scope, "query_id").orderBy("reach").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    enough = reached.withColumn("_n", F.sum("held").over(along)).groupBy(*scope, "query_id").agg(F.coalesce(F.min(F.when(F.col("_n") >= k, F.col("reach"))), F.lit(float("inf"))).alias("reach"))
    bounded = asked.join(staged(enough), [*scope, "query_id"])
    met = index.segments.join(_blocks(bounded, scope, "reach"), [*scope, "dimensions"])
    return met.select(*scope, "cells", "vectors", "chunk_ids", "asked").mapInArrow(score, near_schema)
