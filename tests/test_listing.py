"""What is listed, looked up, kept and counted for a query is no more than it reads, and gives the same rows."""

from __future__ import annotations

import ast

from pyspark.sql import functions as F

from knowloom.functions import text as tx
from knowloom.operators import source_facts as sfx, syntax_nodes as sn, verify as vf

TEXT = '''import os
router = APIRouter(prefix="/a")
class M(BaseModel):
    x: int = os.getenv("X")
    def f(self):
        if x > 1:
            raise ValueError(g(1))
        self.y = h.k(2)[0]
        with open("p") as q:
            def inner(): pass
@router.get("/b")
async def r():
    try:
        return os.environ["Z"]
    finally:
        db.commit()
if __name__ == "__main__":
    r()
'''


def test_only_the_nodes_of_asked_kinds_are_listed():
    kinds = lambda *some: [n[2] for n in sn.syntax_nodes(TEXT, sn.Listing(some))]
    assert kinds("symbol") == ["ClassDef", "FunctionDef", "FunctionDef", "AsyncFunctionDef"]
    assert kinds("import") == ["Import"] and kinds("exception") == ["Raise"]
    assert "Call" not in kinds("symbol", "route", "model") and kinds("call").count("Call") == 9
    assert len(kinds(*sn.READ)) == len(sn.syntax_nodes(TEXT))
    assert sn.Listing(("symbol",)).below[ast.Assign] == []


def test_asked_kinds_give_the_facts_they_give_among_all(spark):
    keys = [*sfx.REPO, "path"]
    files = spark.createDataFrame([("o", "r", "a/m.py", TEXT), ("o", "r", "bad.py", "def (")], [*keys, "text"])
    every = sn.python_facts(files, keys).collect()
    for kinds in [(k,) for k in sn.READ] + [sfx.WORKFLOW_FACTS, sfx.CLAIM_FACTS, ("symbol", "call"), sfx.COMPONENT_FACTS]:
        told = sn.python_facts(files, keys, kinds).collect()
        assert told and sorted(map(repr, told)) == sorted(repr(f) for f in every if f.kind in kinds), kinds


def test_what_many_files_import_is_looked_up_once(spark):
    rows = [("o", "r", f"src/f{i}.py", "import os\nfrom lib.x import y\nfrom . import lib\n") for i in range(20)]
    rows += [("o", "r", "lib/x.py", ""), ("o", "r", "lib/__init__.py", ""), ("o", "r", "src/lib.py", ""), ("o", "r", "web/a.ts", "import { b } from './b';\n"), ("o", "r", "web/b.ts", "")]
    rows += [("o", "r", "j/com/acme/A.java", "import com.acme.B;\nclass A {}\n"), ("o", "r", "j/com/acme/B.java", "class B {}\n"), (None, "r", "n.py", "import lib\n")]
    files = spark.createDataFrame(rows, [*sfx.REPO, "path", "text"])
    found = sfx.resolve_imports(sfx.extract_facts(files, ("import",)), files)
    got = {(r.organization_id, r.path, r.module): r.resolved_file for r in found.collect()}
    assert len(got) == 63 and got["o", "src/f3.py", "os"] is None and got["o", "src/f3.py", "lib.x"] == "lib/x.py"
    assert got["o", "web/a.ts", "./b"] == "web/b.ts" and got["o", "j/com/acme/A.java", "com.acme.B"] == "j/com/acme/B.java" and got[None, "n.py", "lib"] is None
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    tried = plan[plan.index("Generate posexplode"):]
    assert tried.split("\n")[1].strip(" :+-|").startswith("Aggregate")  # candidates are made of distinct names


def test_only_headings_move_to_find_missing_sections(spark):
    runs = spark.createDataFrame([("o", "r")], sfx.REPO)
    wanted = [(d, s) for d, ss in vf.REQUIRED_SECTIONS.items() for s in ss]
    lines = spark.createDataFrame([("o", "r", d, s) for d, s in wanted[1:]] + [("o", "r", "kt_handover", f"text {i}") for i in range(9)], [*sfx.REPO, "document_id", "line"])
    missing = vf.missing_sections(lines, runs)
    assert [(r.document_id, r.line) for r in missing.collect()] == [wanted[0]]
    plan = missing._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" IN (") + plan.count(" INSET ") >= 1


def test_line_count_is_the_number_of_lines(spark):
    texts = ["", "a", "a\n", "\n", "\r\n", "a\r\nb", "a\r\n\r\n", "a\r", "a\n\r", " x ", "a\x0bb\x1c", "a\x85", "a\x1f\x1e\n\n", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.line_count("t").alias("n"), F.size(tx.lines("t")).alias("m")).collect()
    assert all(r.n == (r.m if r.t is not None else None) or r.t is None for r in rows) and [r.n for r in rows[:5]] == [0, 1, 1, 1, 1]


def test_citations_keep_path_and_range(spark):
    files = spark.createDataFrame([("o", "r", "a.py", "1\n2\n3\n")], [*sfx.REPO, "path", "text"])
    said = "see `a.py:L2` `a.py:L2-L9` `a:L1:L7` `a.py:L3-L2` (`evidence:1`) `no.py:L1-L1` `a.py:L2-L9`"
    lines = spark.createDataFrame([("o", "r", "d", said)], [*sfx.REPO, "document_id", "line"])
    got = sorted((r.path, r.start_line, r.end_line, r.occurrences) for r in vf.invalid_citations(lines, files).collect())
    assert got == [("a.py", 2, 9, 2), ("a.py", 3, 2, 1), ("a:L1", 7, 7, 1), ("no.py", 1, 1, 1)]


def test_lines_are_not_written_again_when_documents_are_replaced(spark):
    from knowloom.operators import render

    runs = spark.createDataFrame([("o", "r", "n", "c")], [*sfx.REPO, "repository_name", "commit_sha"])
    good = [(d, 0, t) for d in render.DOCUMENTS for t in ("**Repository:** `n`", "**Commit:** `c`")] + [(d, 1, s) for d, ss in vf.REQUIRED_SECTIONS.items() for s in ss]
    frame = lambda rows: spark.createDataFrame([("o", "r", d, s, "", 0, t) for d, s, t in rows], render.LINE_COLUMNS)
    kept = []

    def save(df):
        kept.append(df.columns)
        return spark.createDataFrame(df.collect(), df.schema)

    files = spark.createDataFrame([], "organization_id string, repository_id string, path string, text string")
    current, versions, open_ = vf.correct_documents(frame(good[1:]), frame(good), runs, files, save=save)
    assert kept and all("line" not in c for c in kept) and open_.count() == 0
    assert sorted((r.document_id, r.line) for r in current.collect()) == sorted((d, t) for d, _, t in good)
    assert {r.document_id: r.version for r in versions.collect()} == {d: 2 if d == good[0][0] else 1 for d in render.DOCUMENTS}


def test_a_run_keeps_facts_without_ids_and_makes_claims_once(spark, monkeypatch):
    from knowloom.plans import analysis

    files = spark.createDataFrame([("o", "r", "a/m.py", TEXT), ("o", "r", "a/n.py", "import a.m\n")], [*sfx.REPO, "path", "text"])
    runs = spark.createDataFrame([("o", "r", "n", "c")], [*sfx.REPO, "repository_name", "commit_sha"])
    made, claimed = [], []

    def staged(df):
        made.append(df.columns)
        return spark.createDataFrame(df.collect(), df.schema)

    claims = analysis.render.claims
    monkeypatch.setattr(analysis, "staged", staged)
    monkeypatch.setattr(analysis.render, "claims", lambda *a: claimed.append(1) or claims(*a))
    found = analysis.stored(analysis.analyze(files, runs, "c"))
    assert len(claimed) == 1 and "kind" in made[0] and "fact_id" not in made[0] and "evidence_id" in found["facts"].columns
    assert found["shown"].columns == [*sfx.REPO, "evidence_id", "path", "kind", "commit_sha", "line", "end_line"]
    told = {r.evidence_id for r in found["claims"].collect()}
    assert told and {r.evidence_id for r in found["shown"].collect()} == told == {r.evidence_id for r in found["evidence"].collect()}
