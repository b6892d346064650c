import math
import random

import pytest

from knowloom.operators import mapping as mp, retrieval as rt, vector_cells
from knowloom.plans import hybrid

ORG = "organization_id"


def corpus(spark):
    texts = [("chunk_val_url_001", "def validate_repo_url(url): validate_repo_url checks the scheme", 0.01), ("chunk_git_loc_002", "def clone(path): return path", 0.02),
             ("chunk_net_003", "def fetch(host): return host", 0.03), ("chunk_db_004", "def query(sql): return sql", 0.04)]
    return spark.createDataFrame([("o", i, t, [v] * 8) for i, t, v in texts], f"{ORG} string, chunk_id string, text string, embedding array<float>")


def test_fused_scores_of_the_first_ranks(spark):
    c = corpus(spark)
    q = spark.createDataFrame([("o", 1, "validate_repo_url", [0.01] * 8)], f"{ORG} string, query_id int, query_text string, embedding array<float>")
    rows = {r["chunk_id"]: r for r in hybrid.fuse(c, q, c).collect()}
    top, second = rows["chunk_val_url_001"], rows["chunk_git_loc_002"]
    assert (top["vector_rank"], top["keyword_rank"], top["rrf_score"]) == (1, 1, 0.032787)
    assert (second["vector_rank"], second["keyword_rank"], second["rrf_score"]) == (2, None, 0.016129)


def plain_bm25(docs, query):
    import re

    tok = {i: re.findall(r"\w+", t.lower()) for i, t in docs}
    n, avg = len(tok), sum(map(len, tok.values())) / len(tok)
    df = {}
    for t in tok.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else low for w, v in idf.items()}
    out = {}
    for i, t in tok.items():
        s = sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in re.findall(r"\w+", query.lower()))
        if round(s, 6) > 0:
            out[i] = round(s, 6)
    return out


def test_bm25_by_tenant(spark):
    rnd = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "été", "x_1", "zeta", "the"]
    docs = {o: [(f"{o}{i}", " ".join(rnd.choices(words, weights=[1, 1, 2, 1, 1, 1, 1, 9], k=rnd.randint(0, 14)))) for i in range(40)] for o in ("a", "b")}
    chunks = spark.createDataFrame([(o, i, t) for o, d in docs.items() for i, t in d], f"{ORG} string, chunk_id string, text string")
    asked = [("a", 1, "the alpha alpha"), ("a", 2, "Été x_1 missing"), ("b", 1, "gamma the zeta"), ("b", 3, "nothing here")]
    q = spark.createDataFrame(asked, f"{ORG} string, query_id int, query_text string")
    got = {(r[ORG], r["query_id"], r["chunk_id"]): r["keyword_score"] for r in rt.bm25(chunks, q).collect()}
    want = {(o, i, c): s for o, i, t in asked for c, s in plain_bm25(docs[o], t).items()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_bm25_half_of_the_corpus_is_no_hit(spark):
    c = spark.createDataFrame([("o", "1", "rare word"), ("o", "2", "other text")], f"{ORG} string, chunk_id string, text string")
    q = spark.createDataFrame([("o", 1, "rare")], f"{ORG} string, query_id int, query_text string")
    assert rt.bm25(c, q).count() == 0


@pytest.mark.parametrize("most", [vector_cells.QUESTIONS, 3])
def test_knn_in_blocks_of_queries(spark, monkeypatch, most):
    monkeypatch.setattr(vector_cells, "QUESTIONS", most)
    rnd = random.Random(1)
    vec = lambda: [rnd.choice([0.0, 0.5, 1.0]) for _ in range(3)]  # many equal distances
    rows = [(o, f"c{i:03d}", vec()) for o in ("a", "b") for i in range(60)]
    asked = [(o, i, vec()) for o in ("a", "b") for i in range(5)]
    c = spark.createDataFrame(rows, f"{ORG} string, chunk_id string, embedding array<float>")
    q = spark.createDataFrame(asked, f"{ORG} string, query_id int, embedding array<float>")
    got = {(r[ORG], r["query_id"], r["vector_rank"]): r["chunk_id"] for r in rt.knn(c, q, k=7).collect()}
    for o, i, v in asked:
        order = sorted((round(sum((x - y) ** 2 for x, y in zip(v, w)), 6), cid) for oo, cid, w in rows if oo == o)
        assert [got[(o, i, k + 1)] for k in range(7)] == [cid for _, cid in order[:7]]


def test_intents(spark):
    cases = {
        "What functions are in the same module as summarize()": ("SAME_MODULE_FUNCTIONS", "summarize"), "siblings of function load_data": ("SAME_MODULE_FUNCTIONS", "load_data"),
        "functions defined alongside parse": ("SAME_FILE_FUNCTIONS", "parse"), "list functions in app/core/x.py": ("FILE_SYMBOLS", "app/core/x.py"),
        "what's in main.py": ("FILE_SYMBOLS", "main.py"), "Which file contains function foo": ("CONTAINING_FILE", "foo"), "where is class Bar defined": ("CONTAINING_FILE", "Bar"),
        "which module contains app/x.py": ("CONTAINING_MODULE", "app/x.py"), "How does authentication work?": ("SEMANTIC", None), "  ": ("SEMANTIC", None)}
    df = spark.createDataFrame([(t,) for t in cases], "query_text string")
    assert {r["query_text"]: (r["intent"], r["entity_name"]) for r in rt.classify_intent(df).collect()} == cases


def test_rerank_providers(spark):
    pool = spark.createDataFrame([("o", 1, "a", 1), ("o", 1, "b", 2)], f"{ORG} string, query_id int, chunk_id string, rrf_rank int")
    keys = [ORG, "query_id"]
    assert [(r["chunk_id"], r["rerank_score"]) for r in rt.rerank(pool, keys).orderBy("final_rank").collect()] == [("a", 2.0), ("b", 1.0)]
    assert [r["rerank_score"] for r in rt.rerank(pool, keys, "disabled").collect()] == [None, None]


def test_a_models_scores_order_the_pool_and_rows_it_cannot_score_come_last(spark):
    from knowloom.plans import hybrid

    chunks = spark.createDataFrame([("o", c, f"{c}.txt", "apple " + t) for c, t in (("a", "pie"), ("b", "pie pie"), ("c", "x" * 500), ("d", "tart"))], f"{ORG} string, chunk_id string, filename string, text string")
    vectors = spark.createDataFrame([("o", c, [float(k), 0.0]) for k, c in enumerate("abcd")], f"{ORG} string, chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([("o", 1, "apple pie", [0.0, 0.0])], f"{ORG} string, query_id int, query_text string, embedding array<float>")

    def score(query, text):
        n = text.str.len()
        return n.astype("float64").where(n < 100)  # the long chunk arrives cut to head and tail, and is not scored

    from pyspark.sql import functions as F

    page = hybrid.search(chunks, asked, vectors, score_udf=F.pandas_udf(score, "double")).orderBy("final_rank").collect()
    assert [r["chunk_id"] for r in page] == ["b", "d", "a", "c"] and page[-1]["rerank_score"] is None


def test_min_score_leaves_keyword_hits_alone(spark):
    from knowloom.plans import hybrid

    chunks = spark.createDataFrame([("o", c, f"{c}.txt", t) for c, t in (("a", "plum"), ("b", "rare word"), ("c", "fig"), ("d", "nut"))], f"{ORG} string, chunk_id string, filename string, text string")
    vectors = spark.createDataFrame([("o", "a", [0.1, 0.0]), ("o", "b", [3.0, 0.0]), ("o", "c", [2.0, 0.0])], f"{ORG} string, chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([("o", 1, "rare", [0.0, 0.0])], f"{ORG} string, query_id int, query_text string, embedding array<float>")
    got = {r["chunk_id"]: (r["vector_rank"], r["keyword_rank"]) for r in hybrid.search(chunks, asked, vectors, min_score=0.5).collect()}
    assert got == {"a": (1, None), "b": (None, 1)}


def test_search_and_topology_stay_within_the_tenant(spark):
    from knowloom.operators import graph as g

    nodes = spark.createDataFrame([(o, f"{o}{k}", f"Widget {k}", None) for o in "ab" for k in range(5)], f"{ORG} string, id string, name string, path string")
    asked = spark.createDataFrame([("a", " widget "), ("b", "WIDGET 3"), ("c", "widget")], f"{ORG} string, query_text string")
    assert sorted(r["id"] for r in g.search_nodes(nodes, asked, limit=3).collect()) == ["a0", "a1", "a2", "b3"]
    repos = spark.createDataFrame([("a", "r"), ("b", "r")], f"{ORG} string, repository_id string")
    mods = spark.createDataFrame([(o, "r", f"m{k}") for o in "ab" for k in range(4)], f"{ORG} string, repository_id string, module_id string")
    assert sorted((r[ORG], r["module_id"]) for r in g.topology_modules(repos, mods, 2).collect()) == [("a", "m0"), ("a", "m1"), ("b", "m0"), ("b", "m1")]


def test_request_needs_exactly_one_input():
    mp.check_request("c", None)
    for bad in ((None, None), ("c", "t"), (" ", "")):
        with pytest.raises(ValueError):
            mp.check_request(*bad)


def test_no_pair_joins_in_the_search_plan(spark, sf_dir):
    import __spark_entry__ as entry

    for name in ("hybrid_search", "r5_bm25", "g1_siblings_in_module", "g7_code_expansion", "e7_imports", "e17_path_token_match", "a11_signals"):
        plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    import __spark_entry__ as entry

    plan = entry.queries()["s12_collection_get"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,de)" in plan and "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in plan
    plan = entry.queries()["e3_ownership"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "p_retailprice" not in plan


def test_only_the_best_rows_move(spark, sf_dir):
    import __spark_entry__ as entry

    plan = entry.queries()["r5_bm25"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Partial") > plan.index("Final")


def test_results_carry_their_context(spark):
    page = spark.createDataFrame([("o", 1, "c1", 1), ("o", 1, "c2", 2)], f"{ORG} string, query_id int, chunk_id string, final_rank int")
    chunks = spark.createDataFrame([("o", "c1", "repo:x:module:app", "app/v.py"), ("o", "c2", "", "lost.py")], f"{ORG} string, chunk_id string, module_id string, file_path string")
    files = spark.createDataFrame([("o", "repo:x", "repo:x:module:app", "repo:x:file:app/v.py", "app/v.py"), ("o", "repo:x", "repo:x:module:_root", "repo:x:file:README.md", "README.md")],
                                  f"{ORG} string, repository_id string, module_id string, file_id string, path string")
    owns = spark.createDataFrame([("o", "repo:x:file:app/v.py", "ann@x", "Ann", 5)], f"{ORG} string, file_id string, author_email string, author_name string, commit_count long")
    docs = spark.createDataFrame([("o", "repo:x:module:app", "doc:1", "d/1.md")], f"{ORG} string, module_id string, doc_id string, relative_path string")
    got = {r["chunk_id"]: r for r in hybrid.with_context(page, chunks, files, owns, docs).collect()}
    one = got["c1"]
    assert (one["repository_id"], one["owners"][0]["commit_count"], one["related_count"], one["first_related"]) == ("repo:x", 5, 2, "doc:1")
    assert got["c2"]["file_id"] == "file:lost.py" and got["c2"]["repository_id"] is None
