"""Declarations of Java and script files: long lists, stacked decorators, types in one file."""

import time

from knowloom.operators import source_facts as sfx
from knowloom.operators.declared_facts import declared_facts

FILES = "organization_id string, repository_id string, path string, text string"


def facts_of(spark, path, text):
    return declared_facts(spark.createDataFrame([("o", "r", path, text)], FILES), sfx.REPO + ["path"])


def test_long_lists_of_constants_comments_and_annotations(spark):
    constants = "package p;\npublic enum Big {\n" + "".join(f"    VALUE_{k},\n" for k in range(100_000)) + "    LAST;\n    private int size;\n    public int size() {\n        return size;\n    }\n}\n"
    header = "/*\n" + " * notes on class and interface\n" * 100_000 + " */\npackage p;\n@Entity\nclass Small {\n    private long id;\n}\n"
    noted = "package p;\nclass A {\n" + "    @Note\n" * 50_000 + '    @GetMapping("/x")\n    public String get(\n        long id,\n        String name\n    ) {\n    }\n}\n'
    script = "// class x\n" * 100_000 + "@Controller('c')\nexport class C {\n  @Get('a')\n" + "  @Note()\n\n" * 50_000 + "  find() {}\n}\n"
    start = time.time()
    got = {}
    for path, text in (("p/Big.java", constants), ("p/Small.java", header), ("p/A.java", noted), ("p/c.ts", script)):
        for r in facts_of(spark, path, text).collect():
            got.setdefault(path, []).append((r["kind"], r["owner"], r["name"], r["value"], r["line"]))
    assert set(got["p/Big.java"]) == {("symbol", "p.Big", "Big", "public enum Big", 2), ("symbol", "p.Big.size()", "size", "int size()", 100_005)}
    assert set(got["p/Small.java"]) == {("symbol", "p.Small", "Small", "class Small", 100_005), ("model", "p.Small", "Small", "java_entity", 100_005), ("field", "p.Small", "id", "long", 100_005)}
    assert ("route", "A.get", "GET", "/x", 50_003) in got["p/A.java"] and ("symbol", "p.A.get(long id, String name)", "get", "String get(long id, String name)", 50_004) in got["p/A.java"]
    assert ("route", "p.c.C.find", "GET", "/c/a", 100_003) in got["p/c.ts"] or ("route", "p.c.find", "GET", "/c/a", 100_003) in got["p/c.ts"]
    assert time.time() - start < 60


def test_types_keep_their_own_annotations_and_fields(spark):
    text = (
        "package p;\n@Entity\npublic class A {\n    private int a;\n}\n\nclass B extends A {\n    public String b;\n}\n@Document(\n    collection = \"c\"\n)\nfinal class C<T> {\n    protected final long c = 1;\n"
        "    @RequestMapping(value = \"/r\", method = RequestMethod.PUT)\n    public void put() { }\n    // note\n    public void plain() { }\n}\nrecord R(int x) { }\n"
    )
    got = [tuple(r) for r in facts_of(spark, "p/A.java", text).select("kind", "owner", "name", "value", "line").collect()]
    assert sorted(r[:3] for r in got if r[0] in ("model", "field")) == [("field", "p.A", "a"), ("field", "p.C", "c"), ("model", "p.A", "A"), ("model", "p.C", "C"), ("model", "p.R", "R")]
    assert [(r[1], r[2], r[4]) for r in got if r[0] == "symbol" and "(" not in r[1]] == [("p.A", "A", 3), ("p.B", "B", 7), ("p.C", "C", 13), ("p.R", "R", 20)]
    assert [r[1:] for r in got if r[0] == "route"] == [("A.put", "PUT", "/r", 15)]


def test_first_of_stacked_decorators_counts(spark):
    text = "export class C {\n  @Get('a')\n  @Post('b')\n\n  @Note()\n  async both() {}\n  @Put()\n  one() {}\n}\n"
    got = [tuple(r) for r in facts_of(spark, "c.ts", text).where("kind = 'route'").select("name", "value", "line").collect()]
    assert got == [("GET", "/a", 2), ("PUT", "/", 7)]
