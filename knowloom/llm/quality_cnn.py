"""Quality classifier: a small convolutional network over bytes, trained and run in numpy.

A text is cut into overlapping chunks that cover all its bytes. Each filter looks at a few neighbouring
bytes; its strongest response in a chunk, cut at zero, is one feature of the chunk. A linear layer turns
the features into a chunk's log-odds, and their mean, weighted by the bytes a chunk adds, is the log-odds
of the document. A filter is a table from (place, byte) to weight, so a response is a sum of look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from knowloom.llm.shared import free_name, slices

FILTERS, TAPS = 16, 6
CHUNK, OVERLAP = 1024, 64
PAD = 256
#: Labelled documents per class that the network learns from, and evenly spaced chunks of each.
SAMPLE, SAMPLE_CHUNKS = 1500, 6
EPOCHS, STEP, BATCH = 24, 0.02, 64
THRESHOLD = 0.7
#: Chunks whose responses are in memory at a time.
AT_ONCE = 16


@dataclass
class Model:
    table: np.ndarray  # taps x 257 x filters
    bias: np.ndarray
    weight: np.ndarray
    shift: float
    prior: float  # log-odds to add because the classes were sampled evenly


def chunks(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of ``raw``, padded, and the bytes each one adds; an empty text is one chunk of padding."""
    step = CHUNK - OVERLAP
    starts = np.arange(0, max(1, len(raw) - OVERLAP), step)
    out = np.full((len(starts), CHUNK), PAD, np.int16)
    data = np.frombuffer(raw, np.uint8)
    for row, start in zip(out, starts):
        part = data[start : start + CHUNK]
        row[: len(part)] = part
    added = np.minimum(len(raw) - starts, step).astype(np.float64)
    added[-1] = max(1, len(raw) - starts[-1])
    return out, added


def features(model: Model, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strongest response of each filter in each chunk, before the cut at zero, and its place."""
    taps, _, filters = model.table.shape
    span = CHUNK - taps + 1
    top, where = np.empty((len(batch), filters), np.float32), np.empty((len(batch), filters), np.int64)
    for low in range(0, len(batch), AT_ONCE):
        part = batch[low : low + AT_ONCE]
        sums = model.table[0][part[:, :span]]
        for tap in range(1, taps):
            sums += model.table[tap][part[:, tap : tap + span]]
        place = sums.argmax(axis=1)
        where[low : low + AT_ONCE] = place
        top[low : low + AT_ONCE] = np.take_along_axis(sums, place[:, None, :], axis=1)[:, 0]
    return top + model.bias, where


def responses(model: Model, batch: np.ndarray) -> np.ndarray:
    """As :func:`features`, without places."""
    taps, _, filters = model.table.shape
    span = CHUNK - taps + 1
    top = np.empty((len(batch), filters), np.float32)
    for low in range(0, len(batch), AT_ONCE):
        part = batch[low : low + AT_ONCE]
        sums = np.take(model.table[0], part[:, :span], axis=0)
        for tap in range(1, taps):
            sums += np.take(model.table[tap], part[:, tap : tap + span], axis=0)
        top[low : low + AT_ONCE] = sums.max(axis=1)
    return top + model.bias


def train(samples: list[tuple[list[bytes], int]], prior: float, seed: int = 3) -> Model:
    """Fit the network on documents given as chunks of raw bytes with label 0 or 1, by Adam on the log loss."""
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.3, (TAPS, 257, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), 0.0, prior)
    data = np.full((sum(len(c) for c, _ in samples), CHUNK), PAD, np.int16)
    owner, k = [], 0
    for d, (parts, _) in enumerate(samples):
        for part in parts:
            data[k, : len(part)] = np.frombuffer(part, np.uint8)
            owner.append(d)
            k += 1
    owner = np.array(owner, np.int64)
    firsts = np.searchsorted(owner, np.arange(len(samples) + 1))
    labels = np.array([y for _, y in samples], np.float32)
    params = [model.table, model.bias, model.weight, np.zeros(1, np.float32)]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        rate = STEP * (1 - epoch / EPOCHS) + STEP / 20
        for docs in np.array_split(rng.permutation(len(samples)), max(1, len(samples) // BATCH)):
            rows = np.concatenate([np.arange(firsts[d], firsts[d + 1]) for d in docs])
            local = np.repeat(np.arange(len(docs)), [firsts[d + 1] - firsts[d] for d in docs])
            count = np.bincount(local, minlength=len(docs))
            top, where = features(model, data[rows])
            h = np.maximum(top, 0)
            z = np.bincount(local, weights=h @ model.weight, minlength=len(docs)) / count + params[3][0]
            error = (1 / (1 + np.exp(-z)) - labels[docs]) / len(docs)
            each = (error / count)[local].astype(np.float32)
            down = np.where(top > 0, each[:, None] * model.weight, 0).astype(np.float32)
            grads = [np.zeros_like(model.table), down.sum(0), (each[:, None] * h).sum(0), np.array([error.sum()], np.float32)]
            f = np.broadcast_to(np.arange(FILTERS), where.shape)
            for tap in range(TAPS):
                np.add.at(grads[0][tap], (data[rows[:, None], where + tap], f), down)
            t += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.shift = float(params[3][0])
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled documents per class, those with the smallest hashed ids, none held out.

    Only rows with a label 0 or 1 whose :func:`held_out` is false count; a document labelled more than once has its
    higher label. With a class missing the model knows only the prior. The sample's ids and chunks are collected:
    ``2 * sample * SAMPLE_CHUNKS`` KiB at most.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    odds = np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1))
    picked = None
    for label in (0, 1):
        own = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = own if picked is None else picked.unionAll(own)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = []
            for text in batch.column(2).to_pylist():
                raw = (text or "").encode()
                starts = np.arange(0, max(1, len(raw) - OVERLAP), CHUNK - OVERLAP)
                starts = starts[np.unique(np.linspace(0, len(starts) - 1, min(SAMPLE_CHUNKS, len(starts))).astype(int))]
                parts.append([raw[s : s + CHUNK] for s in starts.tolist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.list_(pa.binary()))], names=["doc_id", "label", "parts"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The sample of ids has a proven bound of twice ``sample`` rows.
    rows = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text").mapInArrow(cut, "doc_id long, label int, parts array<binary>")
    got = sorted(((r.doc_id, [bytes(p) for p in r.parts], r.label) for r in rows.collect()))
    each = [sum(1 for _, _, y in got if y == label) for label in (0, 1)]
    if not all(each):
        return Model(np.zeros((TAPS, 257, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), 0.0, float(odds))
    return train([(parts, y) for _, parts, y in got], float(odds - np.log(each[1] / each[0])))


def held_out(doc_id):
    """True where the label may not be learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with ``score``: the probability of label 1, from all bytes of ``text`` alone.

    A null text scores as the empty one. Rows are scored one by one, so repeats score alike; a clash of names moves the
    new column to ``score_1`` and so on.
    """
    name = free_name(docs, name)
    at = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches):
            out = np.empty(len(batch.column(at)), np.float64)
            wait, size, owners = [], 0, []

            def flush() -> None:
                nonlocal wait, size, owners
                if not owners:
                    return
                logit = np.maximum(responses(model, np.concatenate([c for c, _ in wait])), 0) @ model.weight
                low = 0
                for owner, (part, added) in zip(owners, wait):
                    z = logit[low : low + len(part)] @ added / added.sum() + model.shift + model.prior
                    out[owner] = 1 / (1 + np.exp(-z))
                    low += len(part)
                wait, size, owners = [], 0, []

            for k, text in enumerate(batch.column(at)):
                wait.append(chunks((text.as_py() or "").encode()))
                owners.append(k)
                size += len(wait[-1][0])
                if size >= 512:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, name])

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(name, DoubleType()))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold; all columns stay as they are."""
    name = free_name(docs, "score")
    return score(docs, fit(docs, labels), "score").where(F.col(name) >= threshold).select(*docs.columns)
