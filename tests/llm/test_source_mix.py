import hashlib
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from knowloom.llm import source_mix as sm

DOCS = "doc_id long, text string, source string"


def brute(rows, weights=(3, 1, 2), share=1.5, most=2):
    """(doc_id, source, size, source_size, target, taken), sorted, with plain loops."""
    own = []
    for doc, text, source in rows:
        letters = [c for c in text or "" if c > "\x7f" or "a" <= c.lower() <= "z"]
        quality = max(0.05, len(letters) / len(text)) if text else 0.05
        u = (int(hashlib.md5(":".join(["13", *([str(doc)] if doc is not None else [])]).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        own.append((doc, source, len(re.findall("[^\\x20\\x09-\\x0D]+", text or "")), -math.log(u) / quality))
    sizes = defaultdict(int)
    for _, source, size, _ in own:
        sizes[source] += size
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > most * sizes[s]}
        for s in full or open_:
            target[s] = most * sizes[s] if full else unit * weight[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    out = []
    for s in order:
        epochs = int(target[s] / sizes[s]) if sizes[s] else 0
        rest, before = target[s] - epochs * sizes[s], 0
        for doc, _, size, _ in sorted((r for r in own if r[1] == s), key=lambda r: (r[3], r[0] is not None, r[0] or 0, r[2])):
            out.append((doc, s, size, sizes[s], round(target[s], 6), size * (epochs + (before + size / 2 < rest))))
            before += size
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((*r[:4], round(r[4], 6), r[5]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def many(words):
    rows = [(k, words(1 + k * 7 % 90), "abcdefg"[k % 7 if k % 3 else 0]) for k in range(600)]
    return rows + [(1000 + k, words(5), None) for k in range(9)] + [(2000, words(4000), "lone"), (2001, words(3), "lone"), (3000, None, "empty"), (3001, " ", "empty")]


@pytest.mark.parametrize("steps", [4096, 2])
def test_equals_plain_loops(spark, many, monkeypatch, steps):
    """Also with so few steps that most of a source is put in order."""
    monkeypatch.setattr(sm, "STEPS", steps)
    got = rows_of(sm.mix(spark.createDataFrame(many, DOCS)))
    assert got == brute(many)


def test_targets_are_met_and_reruns_agree(spark, many):
    docs = spark.createDataFrame(many, DOCS)
    got = rows_of(sm.mix(docs))
    assert got == rows_of(sm.mix(docs.repartition(7).withColumn("size", F.lit(1)).withColumn("key", F.lit("x"))))
    taken, target, longest = defaultdict(int), {}, defaultdict(int)
    for _, source, size, _, aim, words in got:
        taken[source] += words
        target[source] = aim
        longest[source] = max(longest[source], size)
        assert words <= 2 * size
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(r[2] for r in got)) < 1e-3


def test_better_documents_are_drawn_more_often(spark):
    docs = spark.createDataFrame([(k, "word " * 10, "s") for k in range(4000)], DOCS).withColumn("good", F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0))
    out = sm.mix(docs, share=0.2, quality=F.col("good")).where("taken > 0").groupBy(F.col("doc_id") % 2).count().collect()
    drawn = {r[0]: r[1] for r in out}
    assert drawn[0] + drawn[1] == 800 and drawn[0] > 2.5 * drawn[1]


def test_odd_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, "c", "x"), (None, "c d e", None), (2, None, None), (3, "\x0bä b\t\n", "é"), (4, "q", "Z"), (5, "", "z")]
    assert rows_of(sm.mix(spark.createDataFrame(rows, DOCS))) == brute(rows)
    assert sm.mix(spark.createDataFrame([], DOCS)).count() == 0
    only = [(k, None, "s") for k in range(3)]
    assert [r[5] for r in rows_of(sm.mix(spark.createDataFrame(only, DOCS)))] == [0, 0, 0]


def test_no_python_in_the_plan(spark, many):
    plan = sm.mix(spark.createDataFrame(many, DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
