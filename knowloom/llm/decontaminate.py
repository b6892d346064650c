"""Benchmark decontamination: n-gram seeds join training passages to test items, local alignment scores them.

One pass over the corpus finds every n-gram that some test item also has, and cuts out the passage around it as word
numbers. How many passages hold an n-gram says how rare it is. An item's seeds are its rare n-grams and, so that no stretch
of it is without a seed, the rarest one of each stretch that has no rare one. N-grams that are nearly rare are thinned to one
for each doubling of their number in a stretch, because edited copies lack just those of their item's that are rarest.
Seeds join passage and item. Pairs with fewer
words in common than the least score asks for are dropped, which loses none, and a Smith-Waterman alignment of whole item
against passage decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from knowloom.llm.shared import slices, staged

WORD = re.compile(r"\w+")
#: Words of a seed; a shorter item is its own seed.
GRAM = 4
#: An n-gram is rare if at most this share of all rows of documents has a passage with it, or RARE_LEAST passages.
RARE_SHARE, RARE_LEAST = 0.001, 20
#: N-grams up to so many times as frequent are nearly rare.
NEARLY = 8
#: N-grams in a row among which an item has a seed.
STRETCH = 8
#: A passage leaks an item if the alignment keeps this share of the item's words (match 1, mismatch and gap -1).
LEAST_SCORE = 0.6
#: Characters of test items that one pass over the corpus looks for; more items take more passes.
BLOCK_CHARS = 8_000_000
#: Words of a passage before a new one begins; passages overlap by the longest item on both sides.
PASSAGE = 2_000


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def gram_hashes(ids: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all n-grams without an unknown word (number 0), and their 64-bit hashes."""
    if len(ids) < gram:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    views = [ids[k : len(ids) - gram + 1 + k] for k in range(gram)]
    at = np.flatnonzero(np.logical_and.reduce([v > 0 for v in views]))
    out = np.full(len(at), gram, np.uint64)
    for v in views:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + v[at].astype(np.uint64)
    return at, out.view(np.int64)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences (match 1, mismatch and gap -1) and where it ends in the passage.

    One row of the table at a time; gaps along the row are a running maximum.
    """
    n = len(passage)
    if not n or not len(item):
        return 0, 0
    ramp = np.arange(n + 1)
    row, best, end = np.zeros(n + 1, np.int64), 0, 0
    for word in item:
        step = np.where(passage == word, 1, -1) if word else np.full(n, -1)
        new = np.zeros(n + 1, np.int64)
        new[1:] = np.maximum(0, np.maximum(row[:-1] + step, row[1:] - 1))
        row = np.maximum.accumulate(new + ramp) - ramp
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def seeds(hashes: list[int], often: dict[int, int], rare: float) -> set[int]:
    """The seeds of an item with these n-grams in order: those in at most ``rare`` passages, and of each STRETCH without one the rarest.

    Of the nearly rare ones in a stretch there is a seed for each doubling. N-grams in no passage are no seeds, and
    neither do they make a stretch rare.
    """
    held = [h for h in hashes if h in often]
    out = {h for h in held if often[h] <= rare}
    for k in range(max(1, len(held) - STRETCH + 1)):
        stretch = sorted((often[h], h) for h in held[k : k + STRETCH])
        if stretch and stretch[0][0] > rare:
            out.add(stretch[0][1])
        doublings = {}
        for n, h in stretch:
            if rare < n <= NEARLY * rare:
                doublings.setdefault(n.bit_length(), h)
        out |= set(doublings.values())
    return out


def _items(benchmark: DataFrame, blocks: int, block: int) -> list[tuple[int | None, list[str]]]:
    """The test items of one block, as words; its size is bounded by BLOCK_CHARS."""
    own = benchmark.where("text is not null").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
    found = [(r.item_id, words(r.text)) for r in own.select(F.col("item_id").cast("long"), "text").distinct().collect()]
    return sorted((r for r in found if r[1]), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def leaks(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, least: float = LEAST_SCORE) -> DataFrame:
    """``doc_id``, ``item_id``, ``score`` (0 to 1), ``end_word`` of every test item that a document holds, copied or edited.

    ``score`` is the best alignment score over the item's number of words; pairs under ``least`` are left out. Words are
    lower-cased runs of letters and digits. Items of fewer than ``gram`` words are found where all their words stand in a
    row. Null texts and texts without a word match nothing. Rows without an id take part; null is then their id, the same
    for all. Repeated rows and repeated ids give one row per pair of ids, with the best score. Extra columns are ignored;
    empty tables give no rows.
    """
    best = _passages_and_items(docs, benchmark, gram, least).groupBy("doc_id", "item_id")
    return best.agg(F.max("score").alias("score"), F.max_by("end_word", F.struct("score", "end_word")).alias("end_word"))


def _passages_and_items(docs: DataFrame, benchmark: DataFrame, gram: int, least: float) -> DataFrame:
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_CHARS) or 1
    out = None
    for block in range(blocks):
        found = _leaks_of(docs, _items(benchmark, blocks, block), gram, least)
        out = found if out is None else out.unionAll(found)
    return out


_FOUND = "doc_id long, version long, item_id long, score double, end_word long"


def _leaks_of(docs: DataFrame, items: list[tuple[int | None, list[str]]], gram: int, least: float) -> DataFrame:
    spark = docs.sparkSession
    number = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in items for w in ws}))}
    coded = [(i, np.array([number[w] for w in ws], np.int32)) for i, ws in items]
    own_grams = [gram_hashes(ids, min(gram, len(ids)))[1].tolist() for _, ids in coded]
    sizes = sorted({min(gram, len(ids)) for _, ids in coded})
    known = np.unique(np.array([h for own in own_grams for h in own], np.int64))
    reach = max((len(ids) for _, ids in coded), default=0)
    sent = spark.sparkContext.broadcast((number, known))

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, known = sent.value
        get = number.get
        for batch in slices(batches):
            ids, versions = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for k, text in enumerate(batch.column(2)):
                found = words(text.as_py() or "") if len(known) else []
                if not found:
                    continue
                coded = np.fromiter((get(w, 0) for w in found), np.int32, count=len(found))
                every = [gram_hashes(coded, n) for n in sizes]
                at, hashes = np.concatenate([e[0] for e in every]), np.concatenate([e[1] for e in every])
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = np.flatnonzero(known[place] == hashes)
                hit = hit[np.argsort(at[hit], kind="stable")]
                at, hashes = at[hit], hashes[hit]
                begin = 0
                while begin < len(at):
                    stop = begin + 1
                    while stop < len(at) and at[stop] - at[stop - 1] <= reach and at[stop] - at[begin] <= PASSAGE:
                        stop += 1
                    low, high = max(0, at[begin] - reach), at[stop - 1] + gram + reach
                    rows.append((ids[k], versions[k], int(low), coded[low:high].tobytes(), sorted(set(hashes[begin:stop].tolist()))))
                    begin = stop
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))], names=["doc_id", "version", "low", "coded", "grams"])

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), F.col("text").cast("string"))
    cut = staged(keyed.mapInArrow(passages, "doc_id long, version long, low long, coded binary, grams array<long>"), "passages")
    # One number for each n-gram of this block of items, whatever the size of the corpus.
    often = {r.gram: r.n for r in cut.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect()}
    rare = max(RARE_LEAST, RARE_SHARE * docs.count())
    by_seed: dict[int, list[int]] = {}
    for k, hashes in enumerate(own_grams):
        for seed in seeds(hashes, often, rare):
            by_seed.setdefault(seed, []).append(k)
    joined = spark.sparkContext.broadcast((coded, by_seed))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded, by_seed = joined.value
        bags: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in slices(batches):
            rows = []
            for doc, version, low, passage, held in zip(*(batch.column(c).to_pylist() for c in range(5))):
                passage = np.frombuffer(passage, np.int32)
                own, times = np.unique(passage, return_counts=True)
                for k in sorted({k for h in held for k in by_seed.get(h, ())}):
                    item, ids = coded[k]
                    if k not in bags:
                        bags[k] = np.unique(ids, return_counts=True)
                    needed, wanted = bags[k]
                    place = np.minimum(np.searchsorted(own, needed), len(own) - 1)
                    if np.minimum(wanted, np.where(own[place] == needed, times[place], 0)).sum() < least * len(ids):
                        continue
                    best, end = align(ids, passage)
                    if best >= least * len(ids) and (best == len(ids) or len(ids) >= gram):
                        rows.append((doc, version, item, best / len(ids), low + end))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["doc_id", "version", "item_id", "score", "end_word"])

    return cut.mapInArrow(score, _FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` that hold no test item, also among those without a ``doc_id``. All columns stay as they are."""
    found = staged(_passages_and_items(docs, benchmark, gram, least).select("doc_id", "version").distinct(), "leaking").toDF("leaking_id", "leaking_version")
    same = docs["doc_id"].cast("long").eqNullSafe(found["leaking_id"]) & (F.xxhash64(docs["text"]) == found["leaking_version"])
    return docs.join(found, same, "left_anti").select(*docs.columns)
