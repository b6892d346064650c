"""Claims and the trees they are read from: kinds of facts that are asked, and texts put together without a formatter."""

from pyspark.sql import functions as F

from knowloom.operators import render, source_facts as sfx
from knowloom.sources import derived_code as dc

TEXT = """import os
from pydantic import BaseModel
router = APIRouter(prefix="/v")
app = FastAPI()

class Item(BaseModel):
    size: int = 3

    def grow(self, by):
        if by > 3:
            raise ValueError("too much")
        self.size = by
        session.commit()

@router.get("/x")
def show(key):
    return os.getenv("KEY")

if __name__ == "__main__":
    show(1)
"""


def test_claims_need_no_other_kinds_of_facts(spark):
    files = spark.createDataFrame([("o", "r", "a/b.py", TEXT), ("o", "r", "bad.py", "def ("), ("o", "r", "P.java", "@Entity\npublic class P {\n  private int n;\n}\n")], "organization_id string, repository_id string, path string, text string")

    def claims(kinds):
        facts = sfx.with_ids(sfx.extract_facts(files, kinds), F.lit("c"))
        return facts, sorted(map(tuple, render.claims(facts, sfx.models(facts), sfx.behaviours(facts)).collect()))

    some, got = claims(sfx.CLAIM_FACTS)
    every, want = claims(None)
    assert got == want and {r[4] for r in got} == {"api_contract", "data_contract", "architecture", "derived_behavior"}
    assert some.count() < every.count() and not some.where(F.col("kind").isin("import", "call", "config")).count()


def test_other_behaviours_from_those_already_made(spark):
    files = spark.createDataFrame([("o", "r", "a/b.py", TEXT.replace("    return os", "    session.flush()\n    return os"))], "organization_id string, repository_id string, path string, text string")
    facts = sfx.extract_facts(files)
    got = sfx.other_behaviours(facts, sfx.behaviours(facts)).collect()
    assert got == sfx.other_behaviours(facts).collect() and [r["qualified_name"] for r in got] == ["a.b.Item.grow"]


def test_texts_are_filled_as_format_string_does(spark):
    rows = spark.createDataFrame([(1, "x"), (-5, ""), (None, None), (1 << 40, "%d")], "k long, s string")
    for template, columns in (("a%db%s", "ks"), ("%s%d", "sk"), ('{"k%d": "%s"}\n', "ks"), ("%d/%s/", "ks"), ("none", "")):
        got = rows.select(dc._filled(template, *columns).alias("got"), F.format_string(template, *columns).alias("want")).collect()
        assert [r["got"] for r in got] == [r["want"] for r in got]
