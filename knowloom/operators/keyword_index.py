"""A stored keyword index: chunks are tokenised once, and searches read postings with bounds.

The index is cut by chunks. A segment has the chunks of one scope that lie in one Arrow batch, so building it moves no
text; per term it has one row with the chunks' numbers, the term's frequencies, and for each block of postings its last
chunk, highest frequency and shortest chunk. Term weights are a table of their own and follow from sums over the segments.

A search joins the questions' terms with postings and weights and scores each segment for a block of questions at a time. Terms
are taken from the highest bound down. Once the terms that are left cannot lift a new chunk over the k-th best, only
chunks within reach are looked up, and blocks whose bound rules them out are passed over. Segments give up k rows a question.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.text import tokens
from ..session import staged

# Okapi constants.
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
#: Postings of a block, and questions of one scope that a task answers at a time.
BLOCK, QUESTIONS = 128, 2_000
#: Scores are rounded to six places, so bounds are compared with this much to spare.
SPARE = 2e-6


@dataclass
class KeywordIndex:
    """``postings`` (a row per scope, segment and term; without a term: the segment's chunks) and ``terms`` (scope, term, idf, avgdl)."""

    scope: list[str]
    postings: DataFrame
    terms: DataFrame


def _segments(table: pa.Table | pa.RecordBatch, scope: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """The scopes of a batch and the rows of each."""
    keys = list(zip(*(table.column(c).to_pylist() for c in range(scope))))
    own: dict[tuple, list[int]] = {}
    for k, key in enumerate(keys):
        own.setdefault(key, []).append(k)
    for key, rows in own.items():
        yield key, np.array(rows)


def _lists(words: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms in order and, by term and chunk: term number, chunk, frequency; and the length of each chunk."""
    lengths = np.diff(words.offsets.to_numpy())
    flat = words.flatten().dictionary_encode()
    names = flat.dictionary.to_pylist()
    place = np.empty(len(names), np.int64)
    place[np.argsort(np.array(names, object), kind="stable")] = np.arange(len(names))
    pairs, often = np.unique(place[flat.indices.to_numpy()] * len(lengths) + np.repeat(np.arange(len(lengths)), lengths), return_counts=True)
    return sorted(names), pairs // max(1, len(lengths)), pairs % max(1, len(lengths)), often, lengths


def _binaries(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """The stretches of ``values`` up to each of ``ends``, as bytes of 32-bit integers."""
    offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values.astype("<i4"))])


def _postings(words: pa.ListArray, ids: pa.Array, block: int) -> list[pa.Array]:
    """``term``, ``n``, ``total``, ``heads``, ``docs``, ``often``, ``chunk_ids`` of a segment: its chunks first, then a row a term.

    Columns are made whole: where scopes are many, segments are small and nearly every word is a row of its own.
    """
    terms, term, doc, often, lengths = _lists(words)
    begin = np.searchsorted(term, np.arange(len(terms) + 1))
    sizes = np.diff(begin)
    blocks = -(-sizes // block)
    before, own = np.repeat(np.cumsum(blocks) - blocks, blocks), np.repeat(blocks, blocks)
    step = np.arange(len(own)) - before
    at = np.repeat(begin[:-1], blocks) + step * block  # blocks tile the postings, so each one ends where the next begins
    heads = np.empty(3 * len(at), np.int64)
    if len(at):
        last = doc[np.append(at[1:], len(doc)) - 1]
        for k, held in enumerate((last, np.maximum.reduceat(often, at), np.minimum.reduceat(lengths[doc], at))):
            heads[3 * before + k * own + step] = held
    none = [None] * len(terms)
    first = lambda rest: pa.concat_arrays([pa.array([None], pa.binary()), rest])
    return [
        pa.array([None, *terms], pa.string()), pa.array(np.concatenate([[len(lengths)], sizes]), pa.int64()), pa.array([int(lengths.sum()), *none], pa.int64()),
        first(_binaries(3 * np.cumsum(blocks), heads)), _binaries(len(lengths) + begin, np.concatenate([lengths, doc])), first(_binaries(begin[1:], often)),
        pa.array([ids.to_pylist(), *none], pa.list_(pa.string())),
    ]


def build(chunks: DataFrame, scope: list[str] = ["organization_id"], block: int = BLOCK) -> KeywordIndex:
    """The index of ``chunks`` (scope columns, chunk_id, text), written once to the shared folder.

    Document frequencies, corpus size and mean length are those of the given chunks, so filters come before the index.
    """
    read = chunks.select(*scope, F.col("chunk_id").cast("string").alias("chunk_id"), F.coalesce(tokens("text"), F.array().cast("array<string>")).alias("words"))
    n = len(scope)
    schema = T.StructType([read.schema[c] for c in scope] + T._parse_datatype_string("segment long, term string, n long, total long, heads binary, docs binary, often binary, chunk_ids array<string>").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for key, rows in _segments(batch, n):
                own = batch.take(pa.array(rows))
                columns = _postings(own.column(n + 1), own.column(n), block)
                many = len(columns[0])
                keys = [pa.array([value] * many, batch.schema.field(c).type) for c, value in enumerate(key)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.full(many, number)), *columns], names=schema.names)
                number += 1

    postings = staged(read.mapInArrow(run, schema))
    counted = postings.groupBy(*scope, "term").agg(F.sum("n").alias("df"), F.sum("total").alias("_total"))
    by_term = counted.where("term is not null").select(*scope, "term", "df")
    by_scope = counted.where("term is null").select(*scope, F.col("df").alias("n"), (F.col("_total") / F.col("df")).alias("avgdl"))
    return KeywordIndex(list(scope), postings, staged(inverse_document_frequency(by_term, by_scope, scope)))


def inverse_document_frequency(by_term: DataFrame, by_scope: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, term, idf, avgdl); negative values are lifted to a quarter of the vocabulary's mean.

    The mean needs only the histogram of document frequencies, which is small whatever the vocabulary.
    """
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    histogram = by_term.groupBy(*scope, "df").agg(F.count(F.lit(1)).alias("_terms"))
    floor = (
        histogram.join(by_scope, scope).groupBy(*scope, "n", "avgdl")
        .agg((BM25_EPSILON * F.sum(raw * F.col("_terms")) / F.sum("_terms")).alias("_floor"))
    )
    return by_term.join(floor, scope).select(
        *scope, "term", "avgdl", F.when(raw < 0, F.col("_floor")).otherwise(raw).alias("idf"))


def query_terms(queries: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, query_id, term, weight): weight counts repeats of a term in the query."""
    return (
        queries.select(*scope, "query_id", F.explode_outer(tokens("query_text")).alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy(*scope, "query_id", "term").agg(F.count(F.lit(1)).alias("weight"))
    )


class _List:
    """A term's postings in one segment; impacts are worked out when they are first needed."""

    def __init__(self, row: dict, lengths: np.ndarray, mean: float):
        self.docs, self.often = np.frombuffer(row["docs"], "<i4"), np.frombuffer(row["often"], "<i4")
        self.last, top, least = np.frombuffer(row["heads"], "<i4").reshape(3, -1)
        self.lengths, self.mean, self.made = lengths, mean, None
        self.blocks = self._impact(top, least)
        self.bound = float(self.blocks.max())

    def _impact(self, often: np.ndarray, length: np.ndarray) -> np.ndarray:
        return often * (BM25_K1 + 1) / (often + BM25_K1 * (1 - BM25_B + BM25_B * length / self.mean))

    def impacts(self) -> np.ndarray:
        if self.made is None:
            self.made = self._impact(self.often, self.lengths[self.docs])
        return self.made

    def add_to(self, docs: np.ndarray, scores: np.ndarray, weight: float, short_of: float) -> tuple[np.ndarray, np.ndarray]:
        """``docs`` within reach of ``short_of`` by the bounds of their blocks, with this term's part added to ``scores``."""
        at = np.searchsorted(self.last, docs)
        held = at < len(self.last)
        bound = np.where(held, self.blocks[np.minimum(at, len(self.last) - 1)], 0.0)
        open_ = scores + weight * bound >= short_of
        docs, scores, held = docs[open_], scores[open_], held[open_]
        place = np.minimum(np.searchsorted(self.docs, docs), len(self.docs) - 1)
        hit = self.docs[place] == docs
        scores[hit] += weight * self.impacts()[place[hit]]
        return docs, scores


def best(lists: list[tuple[float, _List]], n: int, order: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` chunks of a segment with the highest positive scores (ties by ``order``): numbers and rounded scores."""
    lists = sorted(lists, key=lambda x: (x[0] >= 0, -abs(x[0]) * x[1].bound))  # negative weights first: they only take away
    left = np.cumsum([max(w, 0.0) * p.bound for w, p in lists][::-1])[::-1].tolist() + [0.0]
    scores, docs = np.zeros(n), None
    for i, (w, p) in enumerate(lists):
        if docs is None and k is not None and w >= 0 and n > k and scores.max() > left[i]:
            least = np.partition(scores, n - k)[n - k]
            if least - SPARE > left[i]:
                docs = np.flatnonzero(scores + left[i] >= least - SPARE)
                scores = scores[docs]
        if docs is None:
            scores[p.docs] += w * p.impacts()
        else:
            if len(scores) >= k:
                least = max(least, np.partition(scores, len(scores) - k)[len(scores) - k])
            docs, scores = p.add_to(docs, scores, w, least - SPARE - left[i + 1])
    docs = np.arange(n) if docs is None else docs
    rounded = np.round(scores, 6)
    kept = np.flatnonzero(rounded > 0)
    if k is not None and len(kept) > k:
        kept = kept[rounded[kept] >= np.partition(rounded[kept], len(kept) - k)[len(kept) - k]]
    kept = kept[np.lexsort((order[docs[kept]], -rounded[kept]))][:k]
    return docs[kept], rounded[kept]


def search(index: KeywordIndex, queries: DataFrame, k: int | None = 100) -> DataFrame:
    """(scope, query_id, chunk_id, keyword_score): each segment's ``k`` best positive Okapi scores of every query (scope, query_id, query_text)."""
    scope = index.scope
    wanted = query_terms(queries, scope).join(index.terms, [*scope, "term"])
    blocks = queries.groupBy(*scope).agg(F.ceil(F.count("*") / QUESTIONS).cast("int").alias("_blocks"))
    wanted = wanted.join(blocks, scope).withColumn("_block", F.pmod(F.xxhash64("query_id"), "_blocks").cast("int"))
    asks = wanted.groupBy(*scope, "term", "_block").agg(F.collect_list(F.struct("query_id", (F.col("weight") * F.col("idf")).alias("w"))).alias("asks"))
    means = wanted.groupBy(*scope, "_block").agg(F.max("avgdl").alias("avgdl"))
    lists = index.postings.drop("chunk_ids", "total").join(asks, [*scope, "term"])
    chunks = index.postings.where("term is null").select(*scope, "segment", "docs", "chunk_ids").join(means, scope)
    fields = [index.postings.schema[c] for c in scope]
    schema = T.StructType([*fields, T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("chunk_id", T.StringType()), T.StructField("keyword_score", T.DoubleType())])

    def score(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["term"] is None)
        ids, lengths = own["chunk_ids"], np.frombuffer(own["docs"], "<i4")
        order = np.empty(len(ids), np.int64)
        order[np.argsort(np.array(ids, object), kind="stable")] = np.arange(len(ids))
        asked: dict = {}
        for row in rows:
            if row["term"] is not None:
                found = _List(row, lengths, own["avgdl"])
                for ask in row["asks"]:
                    asked.setdefault(ask["query_id"], []).append((ask["w"], found))
        out: tuple[list, list, list] = ([], [], [])
        for query, found in asked.items():
            docs, scores = best(found, len(ids), order, k)
            out[0].extend([query] * len(docs))
            out[1].extend([ids[d] for d in docs.tolist()])
            out[2].extend(scores.tolist())
        kinds = [table.schema.field(c).type for c in scope]
        same = [pa.array([value.as_py()] * len(out[0]), kind) for value, kind in zip(key, kinds)]
        kind = table.schema.field("asks").type.value_type.field("query_id").type
        return pa.table([*same, pa.array(out[0], kind), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=schema.names)

    both = lists.unionByName(chunks, allowMissingColumns=True)
    return both.groupBy(*scope, "segment", "_block").applyInArrow(score, schema)
