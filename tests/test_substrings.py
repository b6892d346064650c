"""Substring search by grams against plain `in`: short needles, scopes, letters beyond ASCII, popular endings."""

import random

from knowloom.operators import graph as g, retrieval as rt, substrings as ss


def test_equals_plain_search(spark):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcé東 _") for _ in range(n))
    texts = [(o, k, make(rng.randint(0, 30))) for o in ("a", "b") for k in range(200)] + [("a", 900, None), ("a", 901, "x" * 20_000 + "needle in it")]
    needles = [(o, make(n)) for o in ("a", "b") for n in (1, 1, 2, 2, 3, 3, 4, 4, 5) for _ in range(3)] + [("a", "needle"), ("c", "a"), ("a", ""), ("b", None), ("a", "zzz")]
    t = spark.createDataFrame(texts, "org string, id int, text string")
    got = {tuple(r) for r in ss.find(t, spark.createDataFrame(needles, "org string, needle string"), ["id"], ["org"]).collect()}
    assert got == {(o, k, n) for o, k, x in texts for p, n in needles if o == p and n and x is not None and n in x}


def test_lines_in_path_order_with_limits(spark):
    files = spark.createDataFrame([("b.py", "one\nTODO two\ntodo"), ("a.py", "x\n\nTo Do\ntodo: 3"), ("c.py", None)], "path string, text string")
    asked = spark.createDataFrame([(1, " todo "), (2, "TODO"), (3, "o"), (4, "nowhere"), (5, " ")], "query_id int, needle string")
    got = {}
    for r in rt.literal_search(files, asked, 2, 6).orderBy("query_id", "path", "line").collect():
        got.setdefault(r["query_id"], []).append((r["path"], r["line"], r["text"]))
    assert got == {1: [("a.py", 4, "todo: "), ("b.py", 2, "TODO t")], 2: [("a.py", 4, "todo: "), ("b.py", 2, "TODO t")], 3: [("a.py", 3, "To Do"), ("a.py", 4, "todo: ")]}


def test_nodes_of_the_tenant_by_name_or_path(spark):
    nodes = [("o", "1", "Alpha", "src/__init__.py"), ("o", "2", "beta", None), ("p", "3", "alphabet", "x"), ("o", "4", None, "lib/ALPHA.py")] + [("o", f"i{k}", "init", f"m{k}/__init__.py") for k in range(50)]
    n = spark.createDataFrame(nodes, "organization_id string, id string, name string, path string")
    asked = spark.createDataFrame([("o", " alpha "), ("p", "alpha"), ("o", "m7/__init__.py"), ("o", " ")], "organization_id string, query_text string")
    found = g.search_nodes(n, asked).collect()
    assert sorted((r["organization_id"], r["query_text"], r["id"]) for r in found) == [("o", " alpha ", "1"), ("o", " alpha ", "4"), ("o", "m7/__init__.py", "i7"), ("p", "alpha", "3")]
    plan = g.search_nodes(n, asked)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_only_grams_of_asked_lengths_are_cut(spark):
    from pyspark.sql import functions as F

    t = spark.createDataFrame([("abcab",), ("ab",)], "text string")
    assert [sorted(r[0]) for r in t.select(ss.grams(F.col("text"), [3])).collect()] == [["abc", "bca", "cab"], []]
    texts = spark.createDataFrame([(1, "abcab"), (2, "ab"), (3, "xa")], "id int, text string")
    for needles, want in ((["bca"], [(1, "bca")]), (["a"], [(1, "a"), (2, "a"), (3, "a")]), (["ab", "cab"], [(1, "ab"), (1, "cab"), (2, "ab")]), ([""], [])):
        assert sorted(map(tuple, ss.find(texts, spark.createDataFrame([(n,) for n in needles], "needle string"), ["id"]).collect())) == want


def test_nodes_are_made_once(spark):
    from pyspark.sql import functions as F

    made = spark.sparkContext.accumulator(0)

    def name(k):
        made.add(1)
        return f"alpha{k}"

    nodes = spark.range(40).repartition(2).select(F.lit("o").alias("organization_id"), F.col("id").cast("string").alias("id"), F.udf(name, "string")("id").alias("name"), F.lit(None).cast("string").alias("path"))
    asked = spark.createDataFrame([("o", "alpha")], "organization_id string, query_text string")
    assert g.search_nodes(nodes, asked).count() == 40 and made.value == 40
