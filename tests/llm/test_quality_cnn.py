import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from knowloom.llm import quality_cnn as q


def test_chunks_cover_every_byte():
    for n in (0, 1, 63, 64, 65, 959, 1023, 1024, 1025, 1984, 1985, 5000):
        raw = bytes(k % 251 for k in range(n))
        made, added = q.chunks(raw)
        step = q.CHUNK - q.OVERLAP
        seen = bytearray(n)
        for k, row in enumerate(made):
            part = row[row != q.PAD]
            assert bytes(part.astype(np.uint8)) == raw[k * step : k * step + q.CHUNK]
            seen[k * step : k * step + len(part)] = b"\1" * len(part)
        assert all(seen) and added.sum() == max(1, n)


def test_fast_and_training_responses_agree():
    rng = np.random.default_rng(0)
    model = q.Model(rng.normal(size=(q.TAPS, 257, q.FILTERS)).astype(np.float32), np.zeros(q.FILTERS, np.float32), None, 0.0, 0.0)
    batch = rng.integers(0, 257, (5, q.CHUNK)).astype(np.int16)
    top, where = q.features(model, batch)
    assert np.allclose(top, q.responses(model, batch))
    k, f = 3, 7
    place = where[k, f]
    brute = [sum(model.table[t, batch[k, p + t], f] for t in range(q.TAPS)) for p in range(q.CHUNK - q.TAPS + 1)]
    assert np.isclose(max(brute), top[k, f], atol=1e-5) and int(np.argmax(brute)) == place


@pytest.fixture(scope="module")
def scored(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = q.fit(docs, labels)
    out = q.score(docs, model).withColumn("held", q.held_out(F.col("doc_id"))).select("doc_id", "text", "score", "held").collect()
    return model, out, {r.doc_id: r.quality for r in labels.collect()}


def test_held_out_rows_are_told_apart(scored):
    model, rows, labels = scored
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held and r.doc_id in labels]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([s >= q.THRESHOLD for s in good]) > 0.97


def test_held_out_labels_are_never_learned_from(spark, docs_of, words):
    docs = docs_of([(k, words(30)) for k in range(200)])
    flip = spark.createDataFrame([(k, int((zlib.crc32(str(k).encode()) % 4 == 2) ^ (k % 2))) for k in range(200)], "doc_id long, quality int")
    plain = spark.createDataFrame([(k, k % 2) for k in range(200) if zlib.crc32(str(k).encode()) % 4 != 2], "doc_id long, quality int")
    a, b = q.fit(docs, flip, sample=20), q.fit(docs, plain, sample=20)
    assert np.array_equal(a.table, b.table) and a.prior == b.prior


def test_odd_rows(spark, scored, docs_of, words):
    model = scored[0]
    rows = [(1, None), (2, ""), (3, words(40_000)), (4, words(5)), (4, words(5)), (None, "é" * 5000)]
    docs = docs_of(rows, ", score double, Score_1 long".replace("double", "long"))
    out = q.score(docs, model)
    assert out.columns == [*docs.columns, "score_2"]
    got = out.collect()
    assert all(0 <= r.score_2 <= 1 for r in got) and len({r.score_2 for r in got if r.text in (None, "")}) == 1
    assert q.score(docs_of([]), model).count() == 0


def test_missing_class_or_labels_leave_the_prior(spark, docs_of):
    docs = docs_of([(k, "some text here") for k in range(8)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in q.score(docs, q.fit(docs, none)).select("score").distinct().collect()] == [0.5]
    ones = spark.createDataFrame([(k, 1) for k in range(8)] + [(1, None), (None, 0)], "doc_id long, quality int")
    assert q.keep_good(docs, ones).count() == 8
