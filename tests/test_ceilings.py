"""Nothing is cut unless the caller asks for it."""

from knowloom.operators import declared_facts as df_, health as h, source_facts as sfx, upkeep as up

ORG = "organization_id"


def test_six_hundred_commits_keep_all_rows(spark):
    rows = [("o", "r", "m", "f", f"{k:04d}", f"A{k % 3}@x.org", f"a{k % 3}", f"2020-01-01 00:{k // 60:02d}:{k % 60:02d}", "f.py") for k in range(600)]
    c = spark.createDataFrame(rows, f"{ORG} string, repository_id string, module_id string, file_id string, sha string, author_email string, author_name string, committed_at string, path string")
    assert h.newest_commits(c).count() == 600
    assert sum(r["commit_count"] for r in h.ownership(h.newest_commits(c)).collect()) == 600
    assert h.newest_commits(c, 500).count() == 500


def test_large_and_many_files_are_walked(spark):
    rows = [("o", "r", f"src/a{k:05d}.py", 2 * 1024 * 1024 + k, False) for k in range(3000)]
    files = spark.createDataFrame(rows, f"{ORG} string, repository_id string, path string, size_bytes long, has_nul boolean")
    assert up.ingestion_walk(files).count() == 3000
    assert up.source_inventory(files).where("reason is null").count() == 3000
    assert up.ingestion_walk(files, max_files=7).count() == 7 and up.ingestion_walk(files, max_bytes=10).count() == 0
    assert up.source_inventory(files, max_files=7).where("reason is null").count() == 7


def test_a_type_with_many_fields_keeps_them(spark):
    body = "".join(f"  private int f{k};\n" for k in range(101))
    notes = "".join(f'@Note{k}("x")\n' for k in range(60))
    text = f"package p;\n@Entity\n{notes}public class Wide {{\n{body}  @GetMapping(\n    value = \"/w\"\n  )\n{notes}  public String get() {{ }}\n}}\n"
    files = spark.createDataFrame([("o", "r", "p/Wide.java", text)], f"{ORG} string, repository_id string, path string, text string")
    facts = df_.declared_facts(files, sfx.REPO + ["path"])
    assert facts.where("kind = 'field'").count() == 101 and facts.where("kind = 'model'").first()["value"] == "java_entity"
    assert [(r["name"], r["value"], r["owner"]) for r in facts.where("kind = 'route'").collect()] == [("GET", "/w", "Wide.get")]


def test_script_and_java_facts_run_no_python(spark):
    files = spark.createDataFrame([("o", "r", "a.ts", "x"), ("o", "r", "A.java", "x")], f"{ORG} string, repository_id string, path string, text string")
    plan = df_.declared_facts(files, sfx.REPO + ["path"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
