import re

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline as cp
from knowloom.llm import quality_cnn as q, shared, unit_dedup as ud
from llm_brute import brute_score, brute_units


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage got and returned, on the small tables."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in cp.STAGES:
        made = shared.staged(stage(spark, docs, sf_dir), name)
        out.append((docs, made))
        docs = made
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "repeated_passages", "benchmark_leaks", "token_ids"]
    for docs, made in stages[:-1]:
        assert made.dtypes == docs.dtypes


def test_quality_keeps_what_reaches_the_threshold(spark, sf_dir, stages):
    docs, made = stages[0]
    model = q.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = {}
    for doc, text in texts(docs).items():
        chunks, added = q.chunks(text.encode())
        z = sum(float(np.maximum(q.responses(model, chunks[k : k + 1])[0], 0) @ model.weight) * added[k] for k in range(len(chunks))) / added.sum() + model.shift + model.prior
        want[doc] = 1 / (1 + np.exp(-z))
    assert set(texts(made)) == {d for d, p in want.items() if p >= q.THRESHOLD}


def test_one_of_each_group_stays(stages):
    """All pairs by their sets of five-word shingles, with plain loops."""
    docs, made = stages[1]
    own = texts(docs)
    sets, label = {}, {i: i for i in own}
    for i, text in own.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    for i in own:
        for j in own:
            if i < j and label[i] != label[j] and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if x == old else x for k, x in label.items()}
    assert texts(made) == {i: own[i] for i in own if label[i] == i} and len(own) > len(texts(made))


def test_repeats_are_cut(stages):
    docs, made = stages[2]
    want = brute_units(sorted(texts(docs).items()), ud)
    assert texts(made) == {d: t for d, (t, _) in want.items()}
    assert all(r.n_chars == len(r.text) for r in made.collect())


def test_leaking_documents_go(spark, sf_dir, stages):
    docs, made = stages[3]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    own = texts(docs)
    gone = set(own) - set(texts(made))
    first = {i: {" ".join(w) for w in zip(*(t.lower().split()[k:] for k in range(4)))} for i, t in enumerate(items)}
    for doc, text in own.items():
        grams = {" ".join(w) for w in zip(*(text.lower().split()[k:] for k in range(4)))}
        near = [items[i] for i in first if len(first[i] & grams) > 2]
        assert (doc in gone) == any(brute_score(t, text) >= 0.6 for t in near)


def test_ids_are_the_tokenizers(stages):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for row in stages[4][1].collect():
        assert row.ids == own.encode_ordinary(row.text) and row.n_tokens == len(row.ids)


def test_run_equals_its_stages(spark, sf_dir, stages):
    key = lambda r: r.doc_id
    assert sorted(cp.run(spark, sf_dir).select("doc_id", "text", "n_tokens", "decoded_sha256").collect(), key=key) == sorted(stages[4][1].select("doc_id", "text", "n_tokens", "decoded_sha256").collect(), key=key)


def test_empty_tables_and_awkward_rows(spark, docs_of, tmp_path, sf_dir):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = docs_of([])
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
    rows = [(1, None), (2, ""), (2, ""), (None, "no id"), (3, "word " * 5000)]
    docs = docs_of(rows, ", ids long, score long, removed long")
    for _, stage in cp.STAGES[1:]:
        docs = shared.staged(stage(spark, docs, str(tmp_path)), "odd")
    assert docs.columns[-3:] == ["ids_1", "n_tokens", "decoded_sha256"] and {r.doc_id for r in docs.collect()} == {1, 3, None}


def test_components_of_paths_stars_and_cycles(spark):
    rng = np.random.default_rng(0)
    edges = [(k, k + 1) for k in range(100, 160)] + [(0, k) for k in range(200, 400)] + [(500, 501), (501, 502), (502, 500), (7, 7)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1300, (200, 2))]
    root = {}
    find = lambda k: k if root.get(k, k) == k else find(root[k])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    got = shared.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == {n: find(n) for n in nodes} and len(got) == len(nodes)
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = shared.forest(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    assert dict(zip(a.tolist(), b.tolist())) == {n: find(n) for n in nodes if find(n) != n}
