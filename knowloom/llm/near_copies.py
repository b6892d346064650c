"""Near copies: documents that share most of their shingles.

Texts meet by the ball search of :mod:`simhash_ball`: those whose SimHash fingerprints link at four or fewer bits are one
group. Two texts that share 0.8 of their shingles often differ in some ten of 64 bits, though, so further fingerprints, each of
a few minima under hash functions of its own, bring together what the ball does not reach: texts with one equal fingerprint
meet as well. Of all that meet the shingles themselves decide. Equal sets of shingles are one node, so copies meet nobody.

Fingerprints are taken in rounds. What the first ones link to one neighbour is one for the next, and a group of a later
round is looked at only if its nodes are still more than one; so most sets of shingles travel once or twice, not once a fingerprint. Groups of
the same nodes are checked once, large groups in pairs of blocks of bounded size, and only texts that meet are read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from knowloom.llm.shared import components, forest, free_name, give_back, marked, slices, staged
from knowloom.llm.simhash_ball import SEED, hashes, linked, simhash

#: Words of a shingle, and the share of all shingles of two texts (Jaccard) that near copies have in common.
SHINGLE, LEAST = 5, 0.8
#: Fingerprints of a text, and minima of each: texts that share 0.8 miss each other with probability (1 - 0.8^5)^18 < 0.001.
PRINTS, MINIMA = 18, 5
#: Fingerprints of each round, and shingles that one task compares; larger groups are dealt in pairs of blocks of half of it.
ROUNDS, GROUP = (5, 13), 1_000_000
#: Bits in which the fingerprints of texts that the ball search brings together differ at most.
RADIUS = 4
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, PRINTS * MINIMA).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes; words as in :func:`simhash_ball.hashes`, no word gives none."""
    return np.unique(hashes(text, shingle))


def prints(found: np.ndarray) -> list[int]:
    """The fingerprints of a set of shingles; an empty set has none."""
    import xxhash

    if not len(found):
        return []
    low = np.empty(len(_ODD), np.uint64)
    for k, odd in enumerate(_ODD):
        x = found * odd
        low[k] = ((x ^ (x >> np.uint64(32))) * odd).min()
    return [int(np.uint64(xxhash.xxh64_intdigest(low[k : k + MINIMA].tobytes(), k)).view(np.int64)) for k in range(0, len(low), MINIMA)]


def alike(sets: list[np.ndarray], least: float = LEAST, known: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what pairs of non-empty sets with a Jaccard similarity of ``least`` connect.

    Pairs already connected, among them those with an equal label in ``known``, are not compared.
    """
    sizes = np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    label, a, b = np.arange(len(sets)) if known is None else np.unique(np.array(known, object), return_inverse=True)[1], [], []
    for k in range(len(sets) - 1):
        rest = np.flatnonzero(label[k + 1 :] != label[k]) + k + 1
        rest = rest[np.minimum(sizes[rest], sizes[k]) >= least * np.maximum(sizes[rest], sizes[k]) - 1e-9]
        if not len(rest):
            continue
        own = np.zeros(int(flat.max()) + 1, bool)
        own[flat[starts[k] : starts[k] + sizes[k]]] = True
        common = np.add.reduceat(own[flat].astype(np.int64), starts)[rest]
        near = rest[common >= least * (sizes[k] + sizes[rest] - common) - 1e-9]
        a += [k] * len(near)
        b += near.tolist()
        label[np.isin(label, label[near])] = label[k]
    return np.array(a, np.int64), np.array(b, np.int64)


def _marks(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id``, ``version`` (hash of the text), ``node`` (128 bits of the set of shingles), ``size``, ``prints`` and ``fp`` (SimHash) of every row."""
    import xxhash

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes, sizes, marked, balls = [], [], [], []
            for text in batch.column(2):
                every = hashes(text.as_py() or "", shingle)
                found = np.unique(every)
                balls.append(simhash(every))
                nodes.append(xxhash.xxh3_128_digest(found.tobytes(), SEED))
                sizes.append(len(found))
                marked.append(prints(found))
            made = [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(marked, pa.list_(pa.int64())), pa.array(balls, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "version", "node", "size", "prints", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), F.col("text").cast("string"))
    return rows.mapInArrow(mark, "doc_id long, version long, node binary, size long, prints array<long>, fp long")


def _links(docs: DataFrame, rows: DataFrame, least: float, shingle: int) -> DataFrame:
    """Edges ``a``, ``b`` between nodes with an equal fingerprint, from ``rows``: ``node``, ``root`` (what it is linked to so far), ``doc_id``, ``version``, ``size``, ``prints``."""
    import xxhash

    # Fingerprints travel with the node alone; what else is known of it comes back to the few that meet.
    each = rows.select(F.explode("prints").alias("print"), "node", "size", F.xxhash64("root").alias("root"))
    groups = each.groupBy("print").agg(F.sum("size").alias("total"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"), F.min("root").alias("low"), F.max("root").alias("high"))
    groups = groups.where("low < high").groupBy("x", "y", "total").agg(F.min("print").alias("print"))
    blocks = F.when(F.col("total") > GROUP, F.ceil(F.col("total") / (GROUP / 2))).otherwise(F.lit(1)).cast("int")
    met = each.select("print", "node").join(groups.select("print", blocks.alias("blocks")), "print").join(rows.select("node", "root", "doc_id", "version"), "node")
    met = met.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    met = staged(met.select("node", "root", "doc_id", "version", "print", "blocks", "block"), "meeting")
    # Only texts that may be among those that meet are looked at again, and only their shingles move, under the node they make.
    wanted = met.select("doc_id", "version").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.col("text").cast("string").alias("text"))
    read = marked(texts, F.xxhash64("doc_id", "version"), wanted, F.xxhash64("doc_id", "version"), "wanted").where("wanted").select("text")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [shingles(x.as_py() or "", shingle).tobytes() for x in batch.column(0)]
            nodes = [xxhash.xxh3_128_digest(x, SEED) for x in made]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(made, pa.binary())], names=["node", "found"])

    def check(rows: pa.Table) -> pa.Table:
        own = {n: (r, f) for n, r, f in zip(*(rows.column(c).to_pylist() for c in ("node", "root", "found")))}
        ids = sorted(own)
        a, b = alike([np.frombuffer(own[i][1], np.uint64) for i in ids], least, [own[i][0] for i in ids])
        a, b = forest(a, b)
        out = pa.table([pa.array([ids[k] for k in side.tolist()], pa.binary()) for side in (a, b)], names=["a", "b"])
        give_back()
        return out

    sets = read.mapInArrow(again, "node binary, found binary").groupBy("node").agg(F.first("found").alias("found"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("blocks") - 1), F.array("block")))
    dealt = met.withColumn("other", F.explode(others)).select("print", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "root")
    return dealt.join(sets, "node").groupBy("print", "i", "j").applyInArrow(check, "a binary, b binary")


def roots(docs: DataFrame, marks: DataFrame, least: float = LEAST, shingle: int = SHINGLE) -> DataFrame:
    """``node`` and ``root`` (smallest node of its component) of all nodes of ``marks``."""
    first = F.min(F.struct("doc_id", "version", "size", "prints", "fp"))
    nodes = staged(marks.groupBy("node").agg(first.alias("row")).select("node", "row.*"), "nodes")
    # What the ball links, equal fingerprints among them, is one more print of the first round.
    ball = components(linked(nodes.where("size > 0"), RADIUS)).select(F.col("id").alias("fp"), "component")
    nodes = nodes.join(ball, "fp", "left").withColumn("ball", F.when(F.col("size") > 0, F.xxhash64(F.lit("ball"), F.coalesce("component", "fp"))))
    nodes = staged(nodes.drop("component", "fp"), "nodes")
    found, edges, begin = nodes.select("node", F.col("node").alias("root")), None, 1
    for n in ROUNDS:
        part = F.slice("prints", begin, n)
        part = F.concat(part, F.array_compact(F.array("ball"))) if edges is None else part
        own = nodes.select("node", "doc_id", "version", "size", part.alias("prints"))
        new = staged(_links(docs, own.join(found, "node"), least, shingle), "links")
        edges, begin = new if edges is None else edges.unionAll(new), begin + n
        # Nodes with one lowest neighbour are linked; that is all the next round needs to know, and takes one aggregation.
        found = _named(nodes, edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")))
    return _named(nodes, components(edges).select(F.col("id").alias("node"), F.col("component").alias("root")))


def _named(nodes: DataFrame, named: DataFrame) -> DataFrame:
    return nodes.select("node").join(named, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, least: float = LEAST, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near copies the row with the smallest ``doc_id``.

    Rows link when their sets of ``shingle``-word shingles have a Jaccard similarity of at least ``least``; a text of fewer
    words is one shingle, and texts without a word, null ones too, are equal to each other. A group is what links reach.
    Rows without a ``doc_id`` take part but cannot be ranked, so they stay. Of rows that repeat the ``doc_id`` that stays
    the one with the smallest text does (null as the empty one). All columns stay as they are, whatever their names; long
    texts are read whole; an empty table gives no rows.
    """
    marks = staged(_marks(docs, shingle), "marks")
    with_root = marks.select("doc_id", "node").join(roots(docs, marks, least, shingle), "node")
    first = with_root.groupBy("root").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    ids = marks.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    # Tables of their own. Only texts that may be lost or repeat a ``doc_id`` move; they meet those tables in one way at every size.
    lost = staged(ids.join(first, "doc_id", "left_anti").select("doc_id"), "lost")
    again = staged(ids.where("n > 1").select("doc_id"), "again")
    mark = free_name(docs, "may_go")
    told = marked(docs, F.xxhash64(F.col("doc_id").cast("long")), lost.unionAll(again), F.xxhash64("doc_id"), mark)
    left = told.where(F.col(mark)).drop(mark).join(lost.hint("merge"), "doc_id", "left_anti")
    more = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("row")).select("row.*")
    others = told.where(~F.col(mark)).select(*docs.columns)
    return others.unionAll(left.join(again, "doc_id", "left_anti").select(*docs.columns)).unionAll(more.select(*docs.columns))
