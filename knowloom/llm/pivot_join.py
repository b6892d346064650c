"""Embedding near-dedup: an exact range join in a metric space cut into cells by pivots.

Unit vectors with cosine ``c`` are ``sqrt(2 - 2c)`` apart, so a cosine threshold is a radius. Every vector is at
home in the cell of its nearest pivot. By the triangle inequality it can only have a partner at home in another
cell ``q`` if it is at most ``2 * radius`` farther from ``q`` than from its own pivot, and at most ``radius`` farther
from ``q`` than the farthest vector at home there; to such cells (of lower number, so that a pair meets once) it
goes as a visitor. Cells join independently, cut into blocks that bound what a task holds; a task counts links and
keeps a spanning forest, so neither pairs nor cliques are ever written. Equal vectors are one node with a weight.
Vectors of different lengths never link: each length that needs more than a block is cut by pivots of its own, all
others join in one pass, a task for each length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from knowloom.llm.shared import components, forest, staged

THRESHOLD = 0.9
#: Vectors at home in a cell, on average; and vectors of a block, on each side of a task.
CELL, BLOCK = 4_000, 4_000
#: The most pivots: they are collected, and every vector is compared with each of them.
MOST_PIVOTS = 1_024
#: Slack in the distance bounds for rounding; it only adds visitors.
SLACK = 1e-9
_LINKS = "node long, links long, a long, b long"


def _unit(column: pa.Array, dim: int | None = None) -> np.ndarray:
    dim = dim or len(column[0])
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ pivots.T)))


def visits(d: np.ndarray, radius: float, far: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each row of pivot distances, and the cells (true) that it has to visit."""
    home = d.argmin(axis=1)
    near = d - d[np.arange(len(d)), home][:, None] <= 2 * radius + SLACK
    if far is not None:
        near &= d <= far[None, :] + radius + SLACK
    return home, near & (np.arange(d.shape[1])[None, :] < home[:, None])


def join_blocks(a: np.ndarray, b: np.ndarray | None, threshold: float) -> np.ndarray:
    """True where a row of ``a`` links with a row of ``b``; without ``b``, rows of ``a`` among themselves."""
    links = a @ (a if b is None else b).T >= threshold
    if b is None:
        np.fill_diagonal(links, False)
    return links


def prepared(vectors: DataFrame) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """All rows as ``vec_id``, ``embedding``; the distinct usable vectors as ``node``, ``n``, ``embedding``; how many of each length.

    ``embedding`` is null for a vector that cannot link: null, empty, zero, or with a null or non-finite component. ``node``
    is the smallest ``vec_id`` of equal vectors.
    """
    e = F.col("embedding")
    good = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, e).alias("embedding"))
    usable = rows.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull())
    nodes = usable.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"))
    nodes = staged(nodes.select("node", "n", "embedding"), "vectors")
    return rows, nodes, {r.dim: r.n for r in nodes.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()}  # one row per length


def pivots_of(nodes: DataFrame, count: int, dim: int) -> np.ndarray:
    """``count`` spread vectors: farthest-first within a sample of eight times as many, those with the smallest hashed ids."""
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(8 * count).select("node", "embedding").collect()
    x = np.array([r.embedding for r in sorted(sample)], np.float64).reshape(-1, dim)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    picked, far = [0], distances(x, x[:1])[:, 0]
    while len(picked) < min(count, len(x)):
        picked.append(int(far.argmax()))
        far = np.minimum(far, distances(x, x[picked[-1:]])[:, 0])
    return x[picked]


def linked(nodes: DataFrame, dim: int, threshold: float = THRESHOLD) -> DataFrame:
    """``node``, ``links`` (links to other nodes, weighted by their copies) and, on other rows, edges ``a``, ``b`` of a spanning forest."""
    many = nodes.count()
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    pivots = pivots_of(nodes, max(1, min(MOST_PIVOTS, many // CELL)), dim)
    cells = len(pivots)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(_unit(batch.column(0), dim), pivots)
            home, visit = visits(d, radius)
            far = np.full(cells, -1.0)
            np.maximum.at(far, home, d[np.arange(len(d)), home])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(np.bincount(home, minlength=cells)), pa.array(visit.sum(axis=0)), pa.array(far)], names=["cell", "homes", "visits", "far"])

    stats = nodes.select("embedding").mapInArrow(survey, "cell long, homes long, visits long, far double").groupBy("cell").agg(F.sum("homes").alias("homes"), F.sum("visits").alias("visits"), F.max("far").alias("far"))
    stats = {r.cell: r for r in stats.collect()}  # one row per pivot
    far = np.array([stats[c].far if c in stats else -1.0 for c in range(cells)])
    home_blocks = np.array([-(-stats[c].homes // BLOCK) if c in stats else 0 for c in range(cells)])
    visit_blocks = np.array([-(-stats[c].visits // BLOCK) if c in stats else 0 for c in range(cells)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task is (cell, home block i, right block j): j below the number of home blocks is one of them, j >= i; later ones hold visitors.
        for batch in batches:
            ids = batch.column(0).to_numpy()
            home, visit = visits(distances(_unit(batch.column(2), dim), pivots), radius, far)
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            own = mixed % home_blocks[home]
            at, task, left = [], [], []
            for k in range(len(ids)):
                c, i, blocks = int(home[k]), int(own[k]), int(home_blocks[home[k]])
                for j in range(i, blocks + int(visit_blocks[c])):
                    at.append(k), task.append((c, i, j)), left.append(True)
                for low in range(i):
                    at.append(k), task.append((c, low, i)), left.append(False)
            rows, to = np.nonzero(visit)
            for k, c in zip(rows.tolist(), to.tolist()):
                if visit_blocks[c]:
                    j = int(home_blocks[c] + mixed[k] % visit_blocks[c])
                    for i in range(int(home_blocks[c])):
                        at.append(k), task.append((c, i, j)), left.append(False)
            step = 2_000
            for low in range(0, len(at), step):
                part, pick = task[low : low + step], pa.array(at[low : low + step], pa.int64())
                columns = [pa.array([t[f] for t in part], pa.int64()) for f in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(left[low : low + step]), *(batch.column(f).take(pick) for f in range(3))], names=["cell", "i", "j", "is_left", "node", "n", "embedding"])

    tasks = nodes.select("node", "n", "embedding").mapInArrow(route, "cell long, i long, j long, is_left boolean, node long, n long, embedding " + nodes.schema["embedding"].dataType.simpleString())
    return tasks.groupBy("cell", "i", "j").applyInArrow(lambda key, rows: _meet(rows, key[1] == key[2], threshold), _LINKS)


def linked_short(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The same for vectors of any lengths, none of which has more than a block of vectors."""
    tasks = nodes.select(F.size("embedding").alias("dim"), F.lit(True).alias("is_left"), "node", "n", "embedding")
    return tasks.groupBy("dim").applyInArrow(lambda rows: _meet(rows, True, threshold), _LINKS)


def _meet(rows: pa.Table, alone: bool, threshold: float) -> pa.Table:
    """Links of a task's left rows with its right ones, or, where it is ``alone``, among its left rows."""
    rows = rows.combine_chunks()
    is_left = rows.column("is_left").to_numpy()
    ids, n = rows.column("node").to_numpy(), rows.column("n").to_numpy()
    x = _unit(rows.column("embedding").combine_chunks())
    a, b = np.flatnonzero(is_left), np.flatnonzero(~is_left)
    if alone:
        links = join_blocks(x[a], None, threshold)
        b = a
    else:
        links = join_blocks(x[a], x[b], threshold)
    p, q = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
    links = links[np.ix_(p, q)]
    a, b = a[p], b[q]
    counts = {"node": [ids[a]], "links": [links @ n[b]]}
    if not alone:
        counts["node"].append(ids[b])
        counts["links"].append(n[a] @ links)
    u, v = _forest_of(links, ids[a], ids[b])
    node, link = np.concatenate(counts["node"]), np.concatenate(counts["links"])
    none = pa.nulls(len(u), pa.int64())
    gone = pa.nulls(len(node), pa.int64())
    return pa.table({"node": pa.chunked_array([pa.array(node), none]), "links": pa.chunked_array([pa.array(link.astype(np.int64)), none]), "a": pa.chunked_array([gone, pa.array(u)]), "b": pa.chunked_array([gone, pa.array(v)])})


def _forest_of(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a dense bipartite link matrix, a slice of rows at a time."""
    a, b = np.empty(0, left.dtype), np.empty(0, left.dtype)
    for low in range(0, len(left), 500):
        p, q = np.nonzero(links[low : low + 500])
        a, b = forest(np.concatenate([a, left[low + p]]), np.concatenate([b, right[q]]))
    return a, b


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every row of ``vectors`` (``vec_id``, ``embedding``).

    Two rows link if the cosine of their vectors, in double precision, is at least ``threshold`` (above 0); every row is
    compared whatever its other columns say. ``component_id`` is the smallest ``vec_id`` reachable by links. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing, and so do rows without a ``vec_id``; vectors
    of different lengths do not link with each other. Repeated rows with one ``vec_id`` are different vectors with one name: they count as
    links of each other. An empty table gives no rows.
    """
    rows, nodes, sizes = prepared(vectors)
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    long = sorted(dim for dim, n in sizes.items() if n > BLOCK)
    found = [staged(linked(nodes.where(F.size("embedding") == dim), dim, threshold), "links") for dim in long]
    if len(long) < len(sizes):
        found.append(staged(linked_short(nodes.where(~F.size("embedding").isin(long)), threshold), "links"))
    found = reduce(DataFrame.unionAll, found)
    counts = found.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node is null").select("a", "b")).select(F.col("id").alias("node"), "component")
    known = nodes.join(counts, "node", "left").join(roots, "node", "left").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    usable = rows.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).join(known, "embedding").select("vec_id", "n_links", "component_id")
    rest = rows.where(F.col("embedding").isNull() | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return usable.unionAll(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
