"""Ranked lexical search with a block-max index and MaxScore.

The index is cut by documents: a segment holds the postings of its own documents only, so building it moves nothing. A
segment's row per term has the postings in blocks, packed as variable-length bytes, and for each block its last document,
its largest term frequency and its smallest document length; these bound what any posting of the block can score.
A search scores each item in each segment on its own and merges the segments' best.

Within a segment lists are ordered by their bounds. Those whose bounds together cannot reach the score of the last kept
document are non-essential: only documents of the other lists become candidates, and a candidate's block in a
non-essential list is unpacked only if its bound can still lift the candidate. Documents are taken in windows, so the
score to beat rises, lists become non-essential and whole windows are passed over as the search goes on.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from knowloom.functions.packing import pack, unpack
from knowloom.llm.shared import slices, staged

#: Runs of letters, digits and whatever is not ASCII, in UTF-8.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Postings of a block, postings after which a segment is closed (a document is never cut), and documents of a window.
BLOCK, SEGMENT_POSTINGS, WINDOW = 128, 2_000_000, 4096
#: Characters of items that one pass over the index answers; more items take more passes.
ITEM_CHARS = 4_000_000

_INDEX = "segment long, term string, n long, total long, blocks binary, postings binary"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, with A-Z lower-cased."""
    return TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Segment:
    """Postings of documents while they are read."""

    def __init__(self):
        self.numbers, self.term, self.often = defaultdict(), array("i"), array("i")
        self.numbers.default_factory = self.numbers.__len__  # a new term takes the next number
        self.held, self.lengths, self.doc_ids = array("i"), array("q"), []

    def add(self, doc_id: int | None, counts: Counter) -> None:
        self.term.extend(map(self.numbers.__getitem__, counts))
        self.often.extend(counts.values())
        self.held.append(len(counts))
        self.lengths.append(sum(counts.values()))
        self.doc_ids.append(doc_id)

    def close(self, number: int, block: int) -> pa.RecordBatch:
        """The index rows of this segment: one without a term for the documents, then one per term in order."""
        names = sorted(self.numbers)
        place = np.empty(len(names), np.int64)
        place[[self.numbers[t] for t in names]] = np.arange(len(names))
        term, lengths = place[np.frombuffer(self.term, np.int32)], np.frombuffer(self.lengths, np.int64)
        order = np.argsort(term, kind="stable")
        doc = np.repeat(np.arange(len(lengths)), np.frombuffer(self.held, np.int32))[order]
        often = np.frombuffer(self.often, np.int32)[order].astype(np.int64)
        df = np.bincount(term, minlength=len(names))
        begin = np.concatenate([[0], np.cumsum(df)[:-1]])
        head = (np.arange(len(doc)) - np.repeat(begin, df)) % block == 0
        heads = np.flatnonzero(head)
        step = np.where(head, doc, doc - np.concatenate([[0], doc[:-1]]))
        ends = np.concatenate([heads[1:], [len(doc)]])
        data, where = pack(np.stack([step, often], 1).ravel())
        shape = [doc[ends - 1], np.maximum.reduceat(often, heads), np.minimum.reduceat(lengths[doc], heads), where[2 * ends] - where[2 * heads]]
        head_data, head_where = pack(np.stack(shape, 1).ravel())
        first = np.searchsorted(heads, begin)
        documents, sizes = packed_ids(self.doc_ids), pack(lengths)[0].tobytes()
        columns = [
            pa.array(np.full(len(names) + 1, number)), pa.array([None, *names], pa.binary()).cast(pa.string()), pa.array(np.concatenate([[len(lengths)], df])), pa.array(np.concatenate([[int(lengths.sum())], df * 0])),
            _binary(sizes, head_data, head_where[4 * first]), _binary(documents, data, where[2 * begin]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["segment", "term", "n", "total", "blocks", "postings"])


def _binary(first: bytes, data: np.ndarray, begins: np.ndarray) -> pa.Array:
    """A column of bytes: ``first``, then ``data`` cut where the others begin."""
    at = np.concatenate([[0], begins + len(first), [len(data) + len(first)]])
    return pa.Array.from_buffers(pa.binary(), len(begins) + 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(first + data.tobytes())])


def packed_ids(ids: list[int | None]) -> bytes:
    """Eight bytes an id, then a byte each that is 1 for null."""
    return np.array([i or 0 for i in ids], "<i8").tobytes() + bytes([i is None for i in ids])


def unpacked_ids(data: bytes) -> list[int | None]:
    n = len(data) // 9
    return [None if none else i for i, none in zip(np.frombuffer(data, "<i8", n).tolist(), data[8 * n :])]


def build(docs: DataFrame, block: int = BLOCK, segment_postings: int = SEGMENT_POSTINGS) -> DataFrame:
    """The index of all rows of ``docs`` (``doc_id``, ``text``), written as a table of the shared folder.

    Per segment a row without a ``term`` (``n`` documents, ``total`` terms; their lengths and ids in place of blocks and
    postings) and one per term: ``n`` documents, in ``blocks`` the last document, largest frequency, smallest length and
    number of bytes of each block, and in ``postings`` steps from document to document and frequencies. Documents without a
    term are not in it. A segment is what a task reads, cut after so many postings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own = TaskContext.get().partitionId() << 32, Segment()
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if counts := Counter(terms_of(text.as_py())):
                    own.add(doc_id, counts)
                    if len(own.term) >= segment_postings:
                        yield own.close(number, block)
                        number, own = number + 1, Segment()
        if own.doc_ids:
            yield own.close(number, block)

    return staged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _INDEX), "postings")


class Postings:
    """A term's list in one segment; blocks are unpacked when they are asked for, once."""

    def __init__(self, row: dict, impact, lengths: np.ndarray):
        shape = unpack(row["blocks"]).reshape(-1, 4)
        self.last, self.data = shape[:, 0], row["postings"]
        self.at = [0, *np.cumsum(shape[:, 3]).tolist()]
        self.bounds = impact(shape[:, 1], shape[:, 2])
        self.impact, self.lengths, self.read = impact, lengths, {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        if k not in self.read:
            values = unpack(memoryview(self.data)[self.at[k] : self.at[k + 1]])
            docs = np.cumsum(values[0::2])
            self.read[k] = docs, self.impact(values[1::2], self.lengths[docs])
        return self.read[k]

    def span(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts from document ``low`` to before ``high``."""
        if (low, high) not in self.read:
            a, b = np.searchsorted(self.last, [low, high])
            parts = [self.block(k) for k in range(a, min(b + 1, len(self.last)))]
            docs = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int64)
            impacts = np.concatenate([p[1] for p in parts]) if parts else docs
            i, j = np.searchsorted(docs, [low, high])
            self.read[low, high] = docs[i:j], impacts[i:j]
        return self.read[low, high]

    def top(self, low: int, high: int) -> int:
        """The largest bound of the blocks that may hold a document from ``low`` to before ``high``."""
        a, b = np.searchsorted(self.last, [low, high])
        return int(self.bounds[a : b + 1].max(initial=0))


def best(lists: list[tuple[int, Postings]], doc_ids: np.ndarray, k: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Documents (their numbers) and scores of the ``k`` highest sums of weight times impact, equal ones by ``doc_ids``."""
    lists = sorted(((w, p, int(w * p.bounds.max())) for w, p in lists if w > 0), key=lambda x: x[2])
    reach = np.cumsum([x[2] for x in lists])
    kept, scores, least = np.empty(0, np.int64), np.empty(0, np.int64), 1
    for low in range(0, len(doc_ids) if lists else 0, window):
        high = min(low + window, len(doc_ids))
        tops = [w * p.top(low, high) for w, p, _ in lists]
        below = np.concatenate([[0], np.cumsum(tops)])
        if below[-1] < least:
            continue
        first = int(np.searchsorted(reach, least))  # lists before this one are non-essential
        found = np.zeros(high - low, np.int64)
        for w, p, _ in lists[first:]:
            docs, impacts = p.span(low, high)
            found[docs - low] += w * impacts
        docs = np.flatnonzero((found > 0) & (found + below[first] >= least))
        own = found[docs]
        for i in range(first - 1, -1, -1):
            w, p, _ = lists[i]
            at = np.searchsorted(p.last, docs + low)
            bound = np.where(at < len(p.last), p.bounds[np.minimum(at, len(p.last) - 1)], 0)
            open_ = own + w * bound + below[i] >= least
            docs, own, at, bound = docs[open_], own[open_], at[open_], bound[open_]
            for b in np.unique(at[bound > 0]):
                mine = np.flatnonzero(at == b)
                there, impacts = p.block(int(b))
                place = np.minimum(np.searchsorted(there, docs[mine] + low), len(there) - 1)
                own[mine] += np.where(there[place] == docs[mine] + low, w * impacts[place], 0)
        kept, scores = np.concatenate([kept, docs + low]), np.concatenate([scores, own])
        order = np.lexsort([doc_ids[kept], -scores])[:k]
        order = order[scores[order] > 0]
        kept, scores = kept[order], scores[order]
        if len(kept) == k:
            least = max(1, int(scores[-1]))
    return kept, scores


def search(index: DataFrame, items: DataFrame, k: int = 20, window: int = WINDOW) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score`` of the ``k`` best documents of each of ``items`` (``item_id``, ``text``).

    A term's weight is ``floor(1000 ln((2N + 2) / (2 df + 1)))``, N the documents with a term and df those with this one. A
    document's score adds ``weight * (1000000000 tf div (1000 tf + 12 m))`` over the item's terms, repeats included, with
    ``m = 75 + 25 n N div L``, n its terms and L those of all documents. Only scores above 0 count; equal ones rank by
    ``doc_id``, null last. Repeated rows of documents rank one after another. Items with null or empty text have no rows;
    equal rows of items are one item, an id with two texts has a list for each; other columns are ignored; empty tables
    give no rows.
    """
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // ITEM_CHARS) or 1
    whole = index.where("term is null").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    out = None
    for block in range(blocks):
        own = items.where("text is not null").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        asked = sorted(((r.item_id, r.text) for r in own.select(F.col("item_id").cast("long"), "text").distinct().collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        found = _search(index, [(i, Counter(terms_of(t))) for i, t in asked], whole.n or 0, whole.total or 0, k, window)
        out = found if out is None else out.unionAll(found)
    return out


def _search(index: DataFrame, asked: list[tuple[int | None, Counter]], n: int, total: int, k: int, window: int) -> DataFrame:
    """One block of items, whose terms are bounded by ITEM_CHARS."""
    spark = index.sparkSession
    terms = F.broadcast(spark.createDataFrame([(t.decode("utf-8", "replace"),) for t in sorted({t for _, c in asked for t in c})], "term string"))
    lists = index.join(terms, "term", "left_semi").select(*index.columns)
    weights = {r.term.encode(): math.floor(1000 * math.log((2 * n + 2) / (2 * r.df + 1))) for r in lists.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    sent = spark.sparkContext.broadcast((asked, weights))

    def impact(often: np.ndarray, length: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * often // (1000 * often + 12 * (75 + 25 * length * n // total))

    def run(table: pa.Table) -> pa.Table:
        asked, weights = sent.value
        rows = {r["term"]: r for r in table.to_pylist()}
        docs = rows.pop(None)
        lengths, ids = unpack(docs["blocks"]), unpacked_ids(docs["postings"])
        order = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)
        own = {t.encode(): Postings(r, impact, lengths) for t, r in rows.items()}
        out = []
        for number, (item, counts) in enumerate(asked):
            lists = [(weights[t] * c, own[t]) for t, c in counts.items() if t in own]
            kept, scores = best(lists, order, k, window)
            out += [(number, item, ids[d], s) for d, s in zip(kept.tolist(), scores.tolist())]
        return pa.table([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], names=["number", "item_id", "doc_id", "score"])

    heaps = lists.unionByName(index.where("term is null")).groupBy("segment").applyInArrow(run, "number long, item_id long, doc_id long, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
