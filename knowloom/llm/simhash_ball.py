"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most four bits share a variant that is at most two flips from each.
So every distinct fingerprint has its 2,081 variants within two flips, equal variants meet, and all
fingerprints that meet are within four bits of each other.

Variants are dealt into buckets by their lowest bits. Two flips change at most two of these, so a fingerprint
travels once to each bucket around its own, however many of its variants belong there, and the variants are
unfolded where they meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from knowloom.llm.shared import components, forest, slices, staged

SEED = 42
#: Variants that one bucket unfolds at a time, on average: 8 bytes each and some copies.
BUCKET_VARIANTS = 3_000_000
#: The least number of buckets, so that a small table still spreads over the cluster.
LEAST_BUCKETS = 64


def hashes(text: str, shingle: int = 4) -> np.ndarray:
    """XXH64 with seed 42 of all shingles with repeats, in order; A-Z are lower-cased, words are runs without ASCII white space.

    Fewer words than a shingle are one shingle; no word gives none.
    """
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j], SEED) for i, j in zip(starts, ends[shingle - 1 :])], np.uint64)


def simhash(found: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes, as a signed number; no hash gives zero."""
    if not len(found):
        return 0
    octets = found.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ OCTET_BITS for k in range(8)])
    return int(np.packbits(ones * 2 > len(found), bitorder="little").view(np.int64)[0])


def fingerprint(text: str, shingle: int = 4) -> int:
    """The 64-bit SimHash of a whole text: features are its shingles as in :func:`hashes`; no word gives zero."""
    return simhash(hashes(text, shingle))


#: The bits of each byte value, lowest first.
OCTET_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id`` and ``fp`` (long) of every row of ``docs``; a null text counts as the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = np.array([fingerprint(x or "", shingle) for x in batch.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


class Ball:
    """The flips within half the radius, parted by the ``bits`` lowest bits, which name a variant's bucket."""

    def __init__(self, bits: int, half: int):
        self.bits, self.half, self.buckets = bits, half, 1 << bits
        flips = np.array([sum(1 << k for k in picked) for n in range(half + 1) for picked in combinations(range(64), n)], np.uint64)
        low = self.hash(flips)
        order = np.argsort(low, kind="stable")
        #: What the flips change of a bucket's name, and the flips of each such change.
        self.changes, starts = np.unique(low[order], return_index=True)
        self.flips = np.split(flips[order], starts[1:])

    def hash(self, x: np.ndarray) -> np.ndarray:
        return (x & np.uint64(self.buckets - 1)).astype(np.int64)

    def variants(self, x: np.ndarray, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        """All variants of the fingerprints ``x`` that belong to ``bucket``, and the position in ``x`` of each one's owner."""
        low = self.hash(x)
        order = np.argsort(low, kind="stable")
        own = low[order]
        made, owner = [], []
        for change, flips in zip(self.changes, self.flips):
            at = order[np.searchsorted(own, bucket ^ change) : np.searchsorted(own, bucket ^ change, side="right")]
            made.append((x[at][:, None] ^ flips[None, :]).ravel())
            owner.append(np.repeat(at.astype(np.int32), len(flips)))
        return np.concatenate(made), np.concatenate(owner)

    def finer(self, x: np.ndarray, bucket: int) -> list[tuple[Ball, int]]:
        """``bucket``, or, where its variants are too many to unfold at once, the buckets by more bits that make it up."""
        low = self.hash(x)
        many = sum(int((low == bucket ^ int(change)).sum()) * len(flips) for change, flips in zip(self.changes, self.flips))
        if many <= 2 * BUCKET_VARIANTS or self.bits >= 40:
            return [(self, bucket)]
        more = min(40 - self.bits, int(np.ceil(np.log2(many / BUCKET_VARIANTS))))
        ball = Ball(self.bits + more, self.half)
        return [(ball, bucket | k << self.bits) for k in range(1 << more)]


def meet(ball: Ball, x: np.ndarray, bucket: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the fingerprints ``x`` whose variants meet in ``bucket``; each meeting pair is verified."""
    made, owner = ball.variants(x, bucket)
    in_order = np.sort(made)
    twice = np.unique(in_order[1:][in_order[1:] == in_order[:-1]])
    if not len(twice):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # A small table of hashes rules out almost all variants that met nothing before the exact look-up.
    spread = np.uint64(0x9E3779B97F4A7C15)
    hit = np.zeros(1 << 20, bool)
    hit[(twice * spread) >> np.uint64(44)] = True
    kept = np.flatnonzero(hit[(made * spread) >> np.uint64(44)])
    at = np.minimum(np.searchsorted(twice, made[kept]), len(twice) - 1)
    same = twice[at] == made[kept]
    kept, at = kept[same], at[same]
    who = owner[kept]
    order = np.lexsort((x[who], at))
    at, who = at[order], who[order]
    first = np.r_[True, at[1:] != at[:-1]]
    hub = who[np.flatnonzero(first)][np.cumsum(first) - 1]
    pairs = np.unique(np.stack([who[~first], hub[~first]], axis=1), axis=0)
    a, b = x[pairs[:, 0]], x[pairs[:, 1]]
    near = np.bitwise_count(a ^ b) <= radius
    return forest(a[near].view(np.int64), b[near].view(np.int64))


#: Parts in which the members of a component look up its smallest id.
PARTS = 16


def linked(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Edges ``a``, ``b`` between distinct fingerprints (column ``fp``) that connect exactly what links at ``radius`` or fewer bits connect."""
    distinct = prints.select("fp").distinct()
    many = distinct.count()
    half = radius // 2
    size = sum(comb(64, n) for n in range(half + 1))
    bits = int(np.ceil(np.log2(max(LEAST_BUCKETS, many * size / BUCKET_VARIANTS))))
    ball = Ball(bits, half)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            for part in np.array_split(x, max(1, len(x) // 2000)):
                to = (ball.hash(part)[:, None] ^ ball.changes[None, :]).ravel()
                order = np.argsort(to, kind="stable")
                to, own = to[order], np.repeat(part, len(ball.changes))[order]
                cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]][: len(to)])
                packed = [p.tobytes() for p in np.split(own, cut[1:])] if len(to) else []
                yield pa.RecordBatch.from_arrays([pa.array(to[cut].astype(np.int64)), pa.array(packed, pa.binary())], names=["bucket", "prints"])

    def gather(key: tuple, rows: pa.Table) -> pa.Table:
        x = np.unique(np.frombuffer(b"".join(rows.column("prints").to_pylist()), np.uint64))
        found = [meet(part, x, name, radius) for part, name in ball.finer(x, key[0].as_py())]
        a, b = forest(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        return pa.table({"a": a, "b": b})

    sent = distinct.mapInArrow(send, "bucket long, prints binary")
    return sent.groupBy("bucket").applyInArrow(gather, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """``doc_id``, ``fp`` (long) and ``component_id`` of every row of ``docs`` (``doc_id``, ``text``).

    Rows link when their fingerprints differ in at most ``radius`` bits, an even number; ``component_id`` is the smallest
    ``doc_id`` reachable by links. Equal fingerprints are one node, so copies cost one row each and no pairs. Null texts
    count as empty, empty texts have fingerprint zero and link like any other, repeated rows each get their row, rows
    without a ``doc_id`` stay and take part, a component of only such rows has a null id. Extra columns are ignored; an
    empty table gives no rows.
    """
    prints = staged(fingerprints(docs, shingle), "prints")
    return _grouped(prints, radius)


def _grouped(prints: DataFrame, radius: int) -> DataFrame:
    if radius % 2:
        raise ValueError("the radius must be even: both sides meet half-way")
    # One row per fingerprint with its smallest id; only these look up their component, whatever the number of copies.
    prints_of = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "lowest")
    roots = components(linked(prints_of, radius))
    members = roots.withColumnRenamed("id", "fp").join(prints_of, "fp")
    low = members.groupBy("component").agg(F.min("low").alias("component_low"))
    # A large component is dealt by parts of its members, each part with the component's one row.
    parts = F.array(*[F.lit(k) for k in range(PARTS)])
    spread = low.withColumn("part", F.explode(parts))
    named = members.withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(PARTS)).cast("int")).join(spread, ["component", "part"]).select("fp", "component_low")
    lowest = prints_of.join(named, "fp", "left").select("fp", F.coalesce("component_low", "low").alias("component_id"))
    return prints.join(lowest, "fp").select("doc_id", "fp", "component_id")
