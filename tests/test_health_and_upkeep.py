import pytest
from pyspark.sql import functions as F

from knowloom.operators import graph as g, health as h, upkeep as up, verify as vf
from knowloom.sources import files as fs
from knowloom.streaming import ingest

ORG = "organization_id"


def test_score_literals(spark):
    rows = [(80.0, True, 1, 1), (50.0, False, 0, 0), (90.0, True, 9, 4), (100.0, False, 0, 2)]
    df = spark.createDataFrame(rows, "c double, r boolean, n int, b int")
    got = df.select(h.doc_score("c", "r", "n").alias("d"), h.ownership_score("b").alias("o"))
    got = [tuple(r) for r in got.select("d", "o", h.overall_score("d", "o")).collect()]
    assert got == [(95.0, 33.3, 58.0), (50.0, 0.0, 20.0), (100.0, 100.0, 100.0), (100.0, 66.7, 80.0)]


def context(spark, **over):
    base = dict(organization_id="o", module_id="m", module_name="core", total_functions=10, documented_functions=5, undocumented_functions=5, coverage_pct=50.0,
                linked_docs=0, has_readme=False, bus_factor=1, sole_owner="Ann", entry_point_count=0)
    return spark.createDataFrame([{**base, **over}])


def test_gap_sentences(spark):
    got = h.health_scores(context(spark)).first()["gaps"]
    assert got == ["5 of 10 functions missing docstrings (50.0% coverage)", "No README or contributing guide found in this module",
                   "No linked business documents (PRDs, BRDs) found for this module", "Bus factor is 1 — only 1 contributor owns this module (high KT risk)"]
    assert h.health_scores(context(spark, coverage_pct=95.0, has_readme=True, linked_docs=2, bus_factor=3)).first()["gaps"] == []


def fns(spark, n):
    return spark.createDataFrame([("o", "m", f"f{i}", f"f{i:03d}", "", "a.py", 300, False) for i in range(n)],
                                 f"{ORG} string, module_id string, function_name string, function_id string, parent_class string, path string, token_count int, is_documented boolean")


def test_signals_and_questions_are_capped(spark):
    s = h.gap_signals(context(spark), fns(spark, 40))
    assert s.count() == 15 and s.agg(F.max("severity")).first()[0] == 1
    q = h.rule_questions(s).orderBy("number").collect()
    assert [r["number"] for r in q] == list(range(1, 9)) and q[0]["question"].startswith("1. Walk me through `f0`")


def test_no_gaps(spark):
    c = context(spark, coverage_pct=100.0, undocumented_functions=0, has_readme=True, linked_docs=1, bus_factor=3)
    r = h.question_lists(h.gap_signals(c, fns(spark, 0))).first()
    assert r["generation_method"] == "no_gaps_detected" and r["questions"] == h.NO_GAPS_TEXT


def test_manifest_signal(spark):
    m = spark.createDataFrame([("o", "m", "not_found")], f"{ORG} string, module_id string, manifest_status string")
    assert "no_dependency_manifest" in {r["type"] for r in h.gap_signals(context(spark), fns(spark, 0), m).collect()}


def test_tenant_is_required(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1)], f"{ORG} string, id int")
    assert up.tenant(df, "a").count() == 1 and up.tenant(df, "c").count() == 0
    with pytest.raises(ValueError):
        up.tenant(df, " ")


def test_neighbours_stay_in_the_tenant(spark):
    links = spark.createDataFrame([("a", "x", "y", "T"), ("b", "x", "z", "T"), ("a", "w", "x", "T")], f"{ORG} string, source string, target string, type string")
    centre = spark.createDataFrame([("a", "x")], f"{ORG} string, id string")
    assert {(r["neighbour"], r["direction"]) for r in g.neighbours(centre, links).collect()} == {("y", "out"), ("w", "in")}


def test_files_by_partial_path(spark):
    f = spark.createDataFrame([("o", "app/core/main.py", "1"), ("o", "domain.py", "2"), ("o", "a.py", "3"), ("p", "main.py", "4")], f"{ORG} string, path string, file_id string")
    q = spark.createDataFrame([("o", "main.py"), ("o", "core/main.py"), ("o", "a.py")], f"{ORG} string, entity_name string")
    got = {(r["entity_name"], r["file_id"]) for r in g.files_by_path(q, f).collect()}
    assert got == {("main.py", "1"), ("main.py", "2"), ("core/main.py", "1"), ("a.py", "3")}


def test_versions(spark):
    new = spark.createDataFrame([("same", "h"), ("diff", "h2"), ("new", "h")], "doc_id string, content_hash string")
    old = spark.createDataFrame([("same", "h", 0), ("diff", "h1", 4)], "doc_id string, content_hash string, version int")
    got = {r["doc_id"]: (r["version"], r["state"]) for r in up.assign_versions(new, old, ["doc_id"]).collect()}
    assert got == {"same": (1, "unchanged"), "diff": (5, "changed"), "new": (1, "new")}


def test_inventory_budget_is_greedy(spark):
    rows = [("o", "r", "a.py", 60, False), ("o", "r", "b.py", 60, False), ("o", "r", "c.py", 30, False), ("o", "r", "sub/d.py", 10, False), ("o", "r", ".env", 1, False),
            ("o", "r", "x.bin", 1, False), ("o", "r", "node_modules/y.js", 1, False), ("o", "r", "nul.py", 1, True)]
    df = spark.createDataFrame(rows, f"{ORG} string, repository_id string, path string, size_bytes long, has_nul boolean")
    got = {r["path"]: r["reason"] for r in up.source_inventory(df, max_bytes=100).collect()}
    assert got == {"a.py": None, "b.py": "repository_size_limit", "c.py": None, "sub/d.py": None, ".env": "sensitive_file", "x.bin": "binary_or_unsupported",
                   "node_modules/y.js": "generated_or_vendor_directory", "nul.py": "binary_or_unsupported"}


def test_contracts_count_repeats(spark):
    mk = lambda rows: spark.createDataFrame([("k", r) for r in rows], "k string, line string")
    r = vf.contract_metrics(mk(["a", "a", "b"]), mk(["a", "b", "b", "c"]), ["k"]).first()
    assert (r["expected"], r["matched"], r["unexpected"], r["missing"], r["status"]) == (3, 2, 2, 1, "mismatch")


def summary(spark, **over):
    base = dict(organization_id="o", repository_id="r", commit_sha="a" * 40, included_files=3, coverage_status="complete", documents_present=5, documents_incomplete=0,
                verification_status="checks_passed", claims=2, supported_claims=2, contracts=9, incomplete_contracts=0, invalid_citations=0, blocking_findings=0)
    return vf.acceptance_report(vf.acceptance_checks(spark.createDataFrame([{**base, **over}]))).first()


def test_acceptance_ladder(spark):
    ok = summary(spark)
    assert (ok["overall_status"], ok["score_percent"], ok["total_checks"]) == ("ready", 100.0, 10)
    assert summary(spark, coverage_status="partial", verification_status="needs_review")["overall_status"] == "needs_review"
    assert summary(spark, commit_sha="abc")["overall_status"] == "not_ready"


def test_commit_log_and_tree(spark, tmp_path):
    log = tmp_path / "log.txt"
    log.write_text("\x1ea1\x1fAnn\x1fann@x\x1f2024-01-02T00:00:00+00:00\x1f\nsrc/a.py\nsrc/b.py\n\n\x1ea0\x1fBob\x1fBOB@x\x1f2024-01-01T00:00:00+00:00\x1f\nsrc/a.py\n")
    got = {(r["sha"], r["path"]) for r in fs.read_commits(spark, str(log), "o", "r").collect()}
    assert got == {("a1", "src/a.py"), ("a1", "src/b.py"), ("a0", "src/a.py")}
    (tmp_path / "t" / "in").mkdir(parents=True)
    (tmp_path / "t" / "in" / "n.py").write_bytes(b"x\x00y")
    (tmp_path / "t" / "m.py").write_bytes(b"x = 1")
    assert {r["path"]: r["has_nul"] for r in fs.read_tree(spark, str(tmp_path / "t"), "o", "r").collect()} == {"in/n.py": True, "m.py": False}


def test_bundle(tmp_path):
    one = fs.write_bundle({"b.md": b"2", "a.md": b"1", "secret": b"x"}, {"a.md", "b.md"}, str(tmp_path / "b.zip"))
    import zipfile

    assert zipfile.ZipFile(tmp_path / "b.zip").namelist() == ["a.md", "b.md"] and len(one) == 64
    with pytest.raises(ValueError):
        fs.write_bundle({"a": b"123"}, {"a"}, str(tmp_path / "c.zip"), max_bytes=2)


def test_documents_are_written_in_order(spark, tmp_path):
    rows = [("o", "r", "d", 10, "b", 0, "second"), ("o", "r", "d", 10, "c", 0, "third"), ("o", "r", "d", 0, "", 0, "first")]
    df = spark.createDataFrame(rows, f"{ORG} string, repository_id string, document_id string, section int, key string, seq long, line string")
    fs.write_documents(df, str(tmp_path / "out"))
    part = next((tmp_path / "out").rglob("part-*.txt"))
    assert part.read_text() == "first\nsecond\nthird\n" and vf.documents_as_text(df).first()["markdown"] == "first\nsecond\nthird\n"


def test_file_drop_versions(spark, tmp_path):
    drop, tables = tmp_path / "drop", str(tmp_path / "tables")
    drop.mkdir()

    def run():
        ingest.ingest(ingest.dropped_documents(spark, str(drop), "o"), tables, str(tmp_path / "ckpt")).awaitTermination()

    (drop / "a.md").write_text("# A\n" + "one " * 30)
    (drop / "b.exe").write_text("no")
    run()
    (drop / "sub").mkdir()
    (drop / "sub" / "a.md").write_text("# A\n" + "two " * 30)
    (drop / "sub" / "d e+f.txt").write_text("kept \ufffd " * 30)
    (drop / "c.txt").write_text("# A\n" + "plain " * 30)
    (drop / "p.pdf").write_bytes(b"%PDF-1.4 \x00\x01")
    (drop / "w.docx").write_bytes(b"PK\x03\x04")
    run()
    got = {r["doc_id"]: r["version"] for r in ingest.known_versions(spark, tables).collect()}
    assert got == {"doc:a.md": 1, "doc:sub/a.md": 1, "doc:c.txt": 1, "doc:sub/d e+f.txt": 1}
    texts = {r["doc_id"]: r["text"] for r in ingest.current_chunks(spark, tables).collect()}
    assert "one" in texts["doc:a.md"] and "two" in texts["doc:sub/a.md"] and "\ufffd" in texts["doc:sub/d e+f.txt"] and len(texts) == 4
    refused = spark.read.option("basePath", f"{tables}/refused").parquet(f"{tables}/refused")
    assert {(r["doc_id"], r["reason"]) for r in refused.collect()} == {("doc:b.exe", "unsupported_type"), ("doc:p.pdf", "needs_a_reader"), ("doc:w.docx", "needs_a_reader")}


def test_later_deliveries_bring_versions(spark, tmp_path):
    drop, tables = tmp_path / "drop", str(tmp_path / "tables")

    def deliver(name, **texts):
        for path, text in texts.items():
            place = drop / name / path.replace("__", "/")
            place.parent.mkdir(parents=True, exist_ok=True)
            place.with_suffix(".md").write_text("# A\n" + text * 30)
        ingest.ingest(ingest.dropped_documents(spark, str(drop), "o", deliveries=True), tables, str(tmp_path / "ckpt")).awaitTermination()

    deliver("one", a="first ", sub__a="other ", same="equal ")
    deliver("two", a="second ", same="equal ")
    got = {r["doc_id"]: r["version"] for r in ingest.known_versions(spark, tables).collect()}
    assert got == {"doc:a.md": 2, "doc:sub/a.md": 1, "doc:same.md": 1}
    texts = {r["doc_id"]: r["text"] for r in ingest.current_chunks(spark, tables).collect()}
    assert "second" in texts["doc:a.md"] and "other" in texts["doc:sub/a.md"] and len(texts) == 3


def git(*args):
    import subprocess

    return subprocess.run(["git", "-c", "user.name=Ann", "-c", "user.email=ann@x", *args], check=True, capture_output=True, text=True).stdout.strip()


def test_checkout_log_and_reingest(spark, tmp_path):
    from knowloom.plans import repository

    origin = tmp_path / "origin"
    (origin / "pkg").mkdir(parents=True)
    git("init", "-q", str(origin))
    (origin / "pkg" / "a.py").write_text("from pkg.b import g\n\nclass A(B):\n    def f(self):\n        return g()\n\ndef h():\n    return f()\n")
    (origin / "pkg" / "b.py").write_text("class B:\n    pass\n\ndef g():\n    return 1\n")
    (origin / "test_a.py").write_text("import pkg\n")
    (origin / "requirements.txt").write_text("httpx>=1\n")
    (origin / "README.md").write_text("# Read\n" + "words " * 30)
    git("-C", str(origin), "add", "-A")
    git("-C", str(origin), "commit", "-qm", "one")
    sha = fs.checkout(str(origin), str(tmp_path / "copy"))
    assert sha == git("-C", str(origin), "rev-parse", "HEAD")
    fs.write_git_log(str(tmp_path / "copy"), str(tmp_path / "log"))
    commits = fs.read_commits(spark, str(tmp_path / "log"), "o", "repo:x")
    tree = up.ingestion_walk(fs.read_tree(spark, str(tmp_path / "copy"), "o", "repo:x"))
    files = fs.with_text(tree).select("organization_id", "repository_id", "path", "text")
    for _ in range(2):  # a second run replaces the partitions of the first
        repository.write_tables(repository.build_tables(files, commits), str(tmp_path / "out"))
    edges = spark.read.parquet(str(tmp_path / "out" / "edges"))
    short = lambda v: v.split(":")[-1]
    got = {(r["type"], short(r["source"]), short(r["target"])) for r in edges.collect()}
    assert edges.count() == edges.distinct().count()
    for want in [("IMPORTS", "pkg/a.py", "pkg/b.py"), ("METHOD_OF", "f", "A"), ("EXTENDS", "A", "B"), ("CALLS", "h", "f"), ("TESTS", "test_a.py", "pkg/a.py"),
                 ("USED_BY", "httpx", "_root"), ("OWNS", "ann@x", "pkg/a.py"), ("AUTHORED", "ann@x", "g"), ("DOCUMENTS", "x/README.md", "_root")]:
        assert want in got, (want, sorted(got))


def test_pages_without_a_reader(spark, tmp_path):
    (tmp_path / "a.pdf").write_text("no real pages")
    r = fs.read_pages(fs.read_tree(spark, str(tmp_path), "o", "r")).collect()
    assert [(x["path"], x["page_no"], x["text"]) for x in r] == [("a.pdf", 0, None)]
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.txt").write_text("fine")
    got = {x["path"]: (x["text"], x["chunking_method"]) for x in fs.read_documents(fs.read_tree(spark, str(tmp_path), "o", "r")).collect()}
    assert got == {"b.docx": (None, "unreadable"), "c.txt": ("fine", "fixed_window")}
