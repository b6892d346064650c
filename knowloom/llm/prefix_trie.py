"""Prefix trie of conversations: which turns they share, and totals of all subtrees.

A node is a distinct sequence of first turns. It is known by a fingerprint, the exclusive or of two 64-bit hashes of each
turn together with its depth, so prefixes become running values that need no sequence in one place, and equal prefixes
meet in one aggregation that combines before it moves. Texts are hashed where they are read and never travel.

Subtree totals come from a centroid decomposition of the parent-edge forest. A component's centroid is its deepest node
whose subtree holds at least half of the component's weight; the weight of a node is its number of members, because then
the weight of a subtree is known beforehand: the turns that its members have from there on. The nodes with half of the
weight or more are just the path from the centroid up to the component's top. The total of the part below the centroid is
added to all nodes of that path; then the centroid goes, and the part above and the subtrees of its children are
components of at most half the weight. So a chain of a million turns takes twenty rounds, not a million. Components of
many nodes are split by joins, a round at a time; small ones are finished in arrays, many in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from knowloom.llm.shared import staged

#: Every conversation takes its first turns from the first of its hundred; how many follows from its id, fewer than MOST_SHARED.
FAMILY, MOST_SHARED = 100, 6
#: Components with more nodes are split by joins; a task finishes about as many nodes of smaller ones at a time.
TASK_NODES = 20_000
NO_ENDS = hashlib.sha256(b"").hexdigest()


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes over: the crc32 of its decimal id modulo MOST_SHARED."""
    return F.pmod(F.crc32(conv_id.cast("string")), F.lit(MOST_SHARED)).cast("int")


def running(df: DataFrame, group: str, order: list[Column], *values: Column) -> DataFrame:
    """``df`` with ``r0``, ``r1`` ...: the exclusive or of each value over a group's rows up to this one; ``None`` counts rows.

    A group may hold any share of the rows: rows are dealt by range of group and order, run within their range, and take
    on what earlier ranges of their group add up to. Only groups that span ranges have such a carry, two a range at most.
    """
    session = df.sparkSession
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, F.col(group), *order).withColumn("part", F.spark_partition_id())
    dealt = staged(dealt, "ranges")
    total = lambda v: F.count("*") if v is None else F.bit_xor(v)
    join = lambda v, a, b: a + b if v is None else a.bitwiseXOR(b)
    sums = dealt.groupBy(group, "part").agg(*[total(v).alias(f"t{k}") for k, v in enumerate(values)])
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = [(F.sum(f"t{k}") if v is None else F.bit_xor(f"t{k}")).over(earlier).alias(f"c{k}") for k, v in enumerate(values)]
    carry = sums.select(group, "part", *carried).where("c0 is not null")
    here = Window.partitionBy(group, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = dealt.select("*", *[total(v).over(here).alias(f"h{k}") for k, v in enumerate(values)])
    rows = rows.join(carry, [group, "part"], "left")
    out = [join(v, F.col(f"h{k}"), F.coalesce(f"c{k}", F.lit(0))).alias(f"r{k}") for k, v in enumerate(values)]
    return rows.select(*df.columns, *out)


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of all rebuilt conversations (``conv_id``, ``depth``, ``length``, ``digest``, ``n_chars``), and every ``conv_id`` with its ``length``."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.length(text).cast("long").alias("n_chars"),
    )
    placed = running(turns, "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest").asc()], None).withColumnRenamed("r0", "k")
    placed = staged(placed.drop("turn"), "placed")
    counts = placed.groupBy("conv_id").agg(F.count("*").alias("own")).withColumn("h", shared_turns(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    bases = counts.where("conv_id = base").select("base", F.col("own").alias("base_turns"))
    taken = F.least("h", F.coalesce("base_turns", F.lit(0))).alias("taken")
    meta = counts.join(bases, "base", "left").select("conv_id", "base", "h", taken, (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    meta = staged(meta, "lengths")
    own = placed.join(meta, "conv_id").where("k > h").select("conv_id", (F.col("k") - F.col("h") + F.col("taken")).alias("depth"), "length", "digest", "n_chars")
    heads = placed.where((F.col("k") < MOST_SHARED) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    first = heads.join(meta, "base").where("k <= taken").select("conv_id", F.col("k").alias("depth"), "length", "digest", "n_chars")
    return own.unionByName(first), meta.select("conv_id", "length")


def _rows(turns: DataFrame) -> DataFrame:
    """Turns with the fingerprint of the prefix they end (``fa``, ``fb``) and of the one before (``pa``, ``pb``)."""
    marked = turns.withColumns({"ha": F.xxhash64(F.lit(1), "depth", "digest"), "hb": F.xxhash64(F.lit(2), "depth", "digest")})
    done = running(marked.drop("digest"), "conv_id", [F.col("depth").asc()], F.col("ha"), F.col("hb"))
    before = [F.col(r).bitwiseXOR(F.col(h)).alias(p) for r, h, p in (("r0", "ha", "pa"), ("r1", "hb", "pb"))]
    return done.select("conv_id", "depth", "length", "n_chars", F.col("r0").alias("fa"), F.col("r1").alias("fb"), *before)


def ends(last: DataFrame) -> DataFrame:
    """``fa``, ``fb``, ``ends_sha256``: the digest of the ascending decimal ids, joined by commas, of the rows (``fa``, ``fb``, ``conv_id``) of each node.

    Ids of a node are dealt by range and joined where they lie; one task then streams a node's pieces through the digest,
    holding one piece at a time.
    """
    parts = int(last.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = last.repartitionByRange(parts, "fa", "fb", "conv_id").sortWithinPartitions("fa", "fb", "conv_id").select("fa", "fb", "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            cuts = np.r_[0, np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1, len(a)]
            joined = [",".join(map(str, ids[x:y].tolist())) for x, y in zip(cuts[:-1], cuts[1:])]
            at = cuts[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(ids[at]), pa.array(joined)], names=["fa", "fb", "first", "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def closed(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in rows], pa.int64()), pa.array([r[0][1] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["fa", "fb", "ends_sha256"])

        for batch in batches:
            done = []
            for a, b, piece in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3))):
                if key != (a, b):
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(piece.encode())
            yield closed(done)
        if key is not None:
            yield closed([(key, state.hexdigest())])

    joined = dealt.mapInArrow(pieces, "fa long, fb long, first long, piece string")
    return joined.repartition(parts, "fa", "fb").sortWithinPartitions("fa", "fb", "first").mapInArrow(digest, "fa long, fb long, ends_sha256 string")


def decompose(up: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: list[np.ndarray], sums: list[np.ndarray]) -> None:
    """Add to ``sums`` what the subtrees of a forest hold of ``values`` below their own tops, by centroids, all trees at once.

    ``up`` is the index of the parent, a top's is its own; ``weight`` is that of the subtree and is used up.
    """
    n = len(up)
    here = np.arange(n)
    top, alive = np.array(up), np.ones(n, bool)
    while not np.array_equal(top, top[top]):
        top = top[top]
    while alive.any():
        path = alive & (2 * weight >= weight[top])
        deepest = np.full(n, -1)
        np.maximum.at(deepest, top[path], depth[path])
        centroid = path & (depth == deepest[top])
        # The head of a node: the nearest of centroid, child of a centroid or top, upwards from it.
        stop = ~alive | centroid | centroid[up] | (top == here)
        head = np.where(stop, here, up)
        while not np.array_equal(head, head[head]):
            head = head[head]
        below = alive & (centroid | ((head != top) & ~centroid))
        for value, total in zip(values, sums):
            low = np.zeros(n, total.dtype)
            np.add.at(low, top[below], value[below])
            total[path] += low[top[path]]
        gone = np.zeros(n, weight.dtype)
        gone[top[centroid]] = weight[centroid]
        weight[path] -= gone[top[path]]
        top = head
        alive &= ~centroid


def rollup(nodes: DataFrame, rows: DataFrame, values: list[str], task_nodes: int = TASK_NODES) -> DataFrame:
    """``fa``, ``fb`` and a sum over its subtree of each of ``values`` for every one of ``nodes``.

    ``nodes`` has ``fa``, ``fb``, ``pa``, ``pb``, ``conv_id``, ``depth``, ``mass`` (weight of the subtree) and the values;
    ``rows`` tell which child of a centroid a node's smallest member goes through.
    """
    sums = [f"s_{v}" for v in values]
    state = nodes.select("fa", "fb", "pa", "pb", "conv_id", "depth", "mass", *values, F.lit(0).cast("long").alias("ca"), F.lit(0).cast("long").alias("cb"), *[F.lit(0).cast("long").alias(s) for s in sums])
    state, finished = staged(state, "forest"), []
    kept = ["fa", "fb", *sums]
    while True:
        big = staged(state.groupBy("ca", "cb").agg(F.count("*").alias("n"), F.max("mass").alias("whole")).where(F.col("n") > task_nodes).drop("n"), "large")
        if big.isEmpty():
            break
        large = state.join(big, ["ca", "cb"])
        on_path = F.col("mass") * 2 >= F.col("whole")
        deepest = large.where(on_path).groupBy("ca", "cb").agg(F.max(F.struct("depth", "fa", "fb", "mass")).alias("z"))
        centroids = staged(big.join(deepest, ["ca", "cb"]).select("ca", "cb", "whole", F.col("z.depth").alias("zd"), F.col("z.fa").alias("za"), F.col("z.fb").alias("zb"), F.col("z.mass").alias("zm")), "centroids")
        kids = rows.join(centroids.select("ca", "cb", F.col("za").alias("pa"), F.col("zb").alias("pb"), (F.col("zd") + 1).alias("depth")), ["pa", "pb", "depth"])
        kids = kids.select("ca", "cb", "conv_id", F.col("fa").alias("ka"), F.col("fb").alias("kb"), F.lit(True).alias("below"))
        met = state.join(centroids, ["ca", "cb"]).join(kids, ["ca", "cb", "conv_id"], "left")
        below = F.coalesce("below", F.lit(False)) & (F.col("depth") > F.col("zd"))
        met = staged(met.withColumns({"path": on_path, "center": (F.col("fa") == F.col("za")) & (F.col("fb") == F.col("zb")), "below": below}), "met")
        low = met.where("center or below").groupBy("ca", "cb").agg(*[F.sum(v).alias(f"l_{v}") for v in values])
        added = {s: F.col(s) + F.when(F.col("path"), F.col(f"l_{v}")).otherwise(0) for s, v in zip(sums, values)}
        split = staged(met.join(low, ["ca", "cb"]).withColumns(added | {"mass": F.col("mass") - F.when(F.col("path"), F.col("zm")).otherwise(0), "ca": F.when(F.col("below"), F.col("ka")).otherwise(F.col("ca")), "cb": F.when(F.col("below"), F.col("kb")).otherwise(F.col("cb"))}).select(*state.columns, "center"), "split")
        finished.append(split.where("center").select(*kept))
        state = staged(state.join(big, ["ca", "cb"], "left_anti").unionByName(split.where("not center").drop("center")), "forest")

    def finish(table: pa.Table) -> pa.Table:
        at = {c: table.column(c).to_numpy(zero_copy_only=False) for c in table.column_names}
        n = table.num_rows
        key = np.stack([np.r_[at["fa"], at["pa"]], np.r_[at["fb"], at["pb"]]], 1)
        _, number = np.unique(key, axis=0, return_inverse=True)
        number = number.ravel()
        place = np.full(2 * n + 1, -1)
        place[number[:n]] = np.arange(n)
        up = place[number[n:]]
        same = (up >= 0) & ~((at["fa"] == at["ca"]) & (at["fb"] == at["cb"]))
        up = np.where(same, up, np.arange(n))
        found = [np.array(at[s]) for s in sums]
        decompose(up, at["depth"].astype(np.int64), np.array(at["mass"]), [at[v] for v in values], found)
        return pa.table([table.column("fa"), table.column("fb"), *map(pa.array, found)], names=kept)

    # Components are dealt whole; what a task gets together is bounded by what it may hold, on average.
    bins = -(-state.count() // task_nodes) or 1
    dealt = state.withColumn("bin", F.pmod(F.xxhash64("ca", "cb"), F.lit(bins)))
    out = dealt.groupBy("bin").applyInArrow(finish, ", ".join(f"{c} long" for c in kept))
    for more in finished:
        out = out.unionByName(more)
    return out.select("fa", "fb", *[F.col(s).alias(v) for s, v in zip(sums, values)])


def trie(conversations: DataFrame, task_nodes: int = TASK_NODES) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations.

    Turns of a conversation are ordered by ``turn``, null first, equal ones by a digest of role and text; null roles and
    texts are empty. A conversation takes its first turns from the first one of its hundred (all it has, if fewer; none if
    it does not exist) and its own after them; it may end up without a turn. A node is a distinct sequence of first turns,
    from the root of no turns; its members are the conversations that begin so.

    Columns, all long but the last: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (the parent's ``conv_id``;
    null for the root), ``n_convs`` (members), ``n_children``, ``n_leaves`` (childless nodes of the subtree, the node
    included), ``saved_tokens`` (over the subtree, (members - 1) times the characters of a node's last text) and
    ``ends_sha256`` (digest of the members that end here). ``conv_id`` and ``depth`` identify a node. Rows without a
    ``conv_id`` belong to no conversation and are left out; repeated rows are repeated turns; other columns are ignored;
    a table without conversations has no nodes, not even a root.
    """
    turns, lengths = rebuilt(conversations)
    rows = staged(_rows(turns), "prefixes")
    whole = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("length") + 1).alias("mass")).first()
    met = rows.groupBy("depth", "fa", "fb").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("pa").alias("pa"), F.min("pb").alias("pb"),
        F.min("n_chars").alias("n_chars"), F.sum(F.col("length") - F.col("depth") + 1).alias("mass"),
    )
    root = rows.sparkSession.range(1 if whole.n_convs else 0).select(
        F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("fa", "fb")], F.lit(whole.conv_id).cast("long").alias("conv_id"), F.lit(whole.n_convs).cast("long").alias("n_convs"),
        *[F.lit(0).cast("long").alias(c) for c in ("pa", "pb")], F.lit(0).cast("long").alias("n_chars"), F.lit(whole.mass).cast("long").alias("mass"),
    )
    nodes = staged(met.unionByName(root), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("fa"), F.col("pb").alias("fb")).agg(F.count("*").alias("n_children"))
    nodes = staged(nodes.join(children, ["fa", "fb"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    valued = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_chars")})
    totals = rollup(valued, rows, ["n_leaves", "saved_tokens"], task_nodes)
    last = rows.where("depth = length").select("fa", "fb", "conv_id").unionByName(lengths.where("length = 0").select(F.lit(0).cast("long").alias("fa"), F.lit(0).cast("long").alias("fb"), "conv_id"))
    # All first turns have the root as their parent, so that one comes as a value and not by a join on one key.
    above = nodes.where("depth > 0").select(F.col("fa").alias("pa"), F.col("fb").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    shallow = nodes.where("depth < 2").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(whole.conv_id).cast("long")))
    placed = nodes.where("depth > 1").join(above, ["pa", "pb"]).unionByName(shallow)
    out = placed.join(totals, ["fa", "fb"]).join(ends(last), ["fa", "fb"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
