from pyspark.sql import functions as F

from knowloom.functions import paths, text as tx
from knowloom.operators import chunking


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr("v")).first()[0]


def test_tokens_keep_letters_of_all_scripts(spark):
    assert one(spark, "Été_1, naïve—ÜBER x2", tx.tokens) == ["été_1", "naïve", "über", "x2"]


def test_approx_tokens_and_strip(spark):
    assert one(spark, "", tx.approx_tokens) == 0
    assert one(spark, "ab", tx.approx_tokens) == 1
    assert one(spark, "a" * 41, tx.approx_tokens) == 10
    assert one(spark, "\n\t  x  ", tx.strip) == "x"


def test_head_tail(spark):
    assert one(spark, "a" * 400, tx.head_tail) == "a" * 400
    long = "h" * 250 + "m" * 100 + "t" * 150
    assert one(spark, long, tx.head_tail) == "h" * 250 + " ... " + "t" * 150


def test_redaction(spark):
    assert one(spark, "https://u:p@host/x git@tok@h", tx.redact_url) == "https://host/x git@h"
    assert one(spark, "API_KEY: 'abc' password = \"q'r\"", tx.redact_secrets) == "API_KEY: '<redacted>' password = \"<redacted>\""


def test_repository_names(spark):
    cases = {"https://host/Team/My-Repo.git": "my-repo", "git@github.com:org/Tool.git": "tool", "/srv/code/App/": "app", "plain": "plain"}
    for given, want in cases.items():
        assert one(spark, given, paths.repository_name) == want


def test_url_rules(spark):
    for given, want in {"": "empty", "file:///x": "unsupported_scheme", "https://": "invalid_format", "https://h/x": None, "git@h:x": None,
                        "/a/../b": "path_traversal", "a/b": "relative_path", "/abs": None}.items():
        assert one(spark, given, paths.repository_url_problem) == want
    for given, want in {"https://github.com/a/b": None, "http://github.com/a": "not_https", "https://u:p@github.com/a": "credentials",
                        "https://github.com/a?x=1": "query_or_fragment", "https://other.org/a": "host_not_enabled"}.items():
        assert one(spark, given, lambda c: paths.remote_url_problem(c, ("github.com",))) == want


def test_git_refs(spark):
    for given, want in {"main": True, "release/1.0": True, "-x": False, "a..b": False, "a/": False, "a.lock": False, "": True}.items():
        assert one(spark, given, paths.git_ref_ok) is want


def test_paths(spark):
    assert one(spark, "src/.env", paths.suffix) == ""
    assert one(spark, "a/b.test.ts", paths.stem) == "b.test"
    assert one(spark, "docs/x.py", paths.is_document) is True
    assert one(spark, "app/requirements.txt", paths.is_document) is True
    assert one(spark, "app/main.py", paths.is_document) is False


def plain_windows(text, window=2000, overlap=300):
    """The window rule once more, as a plain loop."""
    out, start, step = [], 0, window - overlap
    while start < len(text):
        end = min(start + window, len(text))
        if end < len(text):
            for mark in ("\n\n", "\n"):
                at = text.rfind(mark, start + step // 2, end)
                if at >= 0:
                    end = at + len(mark)
                    break
        if text[start:end].strip():
            out.append((start, end))
        if end >= len(text):
            break
        start += step
    return out


def test_windows_match_a_plain_loop(spark):
    import random

    rnd = random.Random(3)
    texts = ["", "  \n ", "x" * 2000, "x" * 2001, "y" * 9000]
    for n in (1999, 2300, 3700, 5401, 12000):
        texts.append("".join(rnd.choice("ab é\n" if rnd.random() < 0.05 else "abcdé ") for _ in range(n)))
        texts.append("".join(rnd.choice(["word ", "\n\n", "\n", "ünï "]) if rnd.random() < 0.02 else "z" for _ in range(n)))
    df = spark.createDataFrame([(str(i), "f.txt", t) for i, t in enumerate(texts)], "doc_id string, filename string, text string")
    got = {}
    for r in chunking.fixed_window_chunks(df, gapless=False).collect():
        got.setdefault(int(r["doc_id"]), []).append((r["start_char"], r["end_char"]))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == plain_windows(t)


def test_gapless_windows_cover_the_text(spark):
    t = ("line of words\n" * 900)
    df = spark.createDataFrame([("d", "f", t)], "doc_id string, filename string, text string")
    spans = sorted((r["start_char"], r["end_char"]) for r in chunking.fixed_window_chunks(df).collect())
    assert spans[0][0] == 0 and spans[-1][1] == len(t)
    assert all(b[0] <= a[1] for a, b in zip(spans, spans[1:]))
    early = "x" * 900 + "\n" + "y" * 3000  # a break so early that the lossy windows leave text out
    df = spark.createDataFrame([("d", "f", early)], "doc_id string, filename string, text string")
    spans = sorted((r["start_char"], r["end_char"]) for r in chunking.fixed_window_chunks(df).collect())
    assert spans[0] == (0, 1700) and spans[1][0] == 1700 and spans[-1][1] == len(early)


def test_documentation_flag(spark):
    body = lambda b: "# File: a\n# Function: f\n\n" + b
    for text, want in {'def f():\n    """doc"""': True, "def f():\n    return 1": False, "function f() {\n  // note\n}": True, "@x\nasync def f():\n\n    # c": True}.items():
        assert one(spark, body(text), lambda c: chunking.is_documented(c, 2)) is want


def test_line_range(spark):
    df = spark.createDataFrame([("a\nb\r\nc\n",)], "v string")
    assert df.select(tx.line_range("v", F.lit(2), F.lit(9))).first()[0] == "b\nc"
