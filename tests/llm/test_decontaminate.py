import numpy as np
import pytest

from knowloom.llm import decontaminate as dc
from llm_brute import brute_score


@pytest.fixture(scope="module")
def items(words):
    return [(k, words(n)) for k, n in enumerate((14, 20, 35, 60, 25))]


def edited(text, every, words):
    own = text.split()
    own[::every] = [words(1) for _ in own[::every]]
    return " ".join(own)


def test_alignment_equals_the_plain_table(words):
    number = {}
    code = lambda t: np.array([number.setdefault(w, len(number) + 1) for w in dc.words(t)], np.int32)
    for _ in range(20):
        item = words(25)
        text = words(10) + " " + edited(item, 6, words) + " " + words(10)
        best, _ = dc.align(code(item), code(text))
        assert best / len(dc.words(item)) == brute_score(item, text)


def test_copies_and_edits_are_found_and_clean_texts_are_not(spark, docs_of, items, words):
    rows = [(k, words(200)) for k in range(100, 130)] + [(1, words(40) + " " + items[2][1] + " " + words(9)), (2, words(30) + ". " + edited(items[3][1], 9, words)), (3, items[0][1].upper().replace(" ", ",\n")), (4, None), (5, ""), (6, words(30_000) + " " + items[1][1]), (None, items[0][1])]
    bench = spark.createDataFrame(items + [(90, None), (91, ""), (92, "two words"), (None, items[1][1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in dc.leaks(docs_of(rows, ", item_id long"), bench).collect()}
    every = items + [(92, "two words"), (None, items[1][1])]
    want = {(d, i): brute_score(t, x) for d, x in rows if x and len(x) < 5000 for i, t in every if brute_score(t, x) >= (dc.LEAST_SCORE if i != 92 else 1)}
    assert {k for k in got if k[0] != 6} == set(want) and got[6, 1] == got[6, None] == 1.0 and (None, 0) in got
    assert all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    left = dc.clean(docs_of(rows), bench)
    assert {r.doc_id for r in left.collect()} == {d for d, _ in rows} - {1, 2, 3, 6, None}


def test_an_item_in_most_documents_is_found_in_all(spark, docs_of, items, words):
    rows = [(k, words(20) + " " + items[4][1] + " " + words(20)) for k in range(400)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert dc.leaks(docs_of(rows), bench).where("item_id = 4").count() == 400


def test_blocks_of_items_and_empty_tables(spark, docs_of, items, words, monkeypatch):
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = docs_of([(k, words(10) + " " + t) for k, t in items] + [(0, words(10) + " " + items[0][1])])
    whole = sorted(map(tuple, dc.leaks(rows, bench).select("doc_id", "item_id", "score").collect()))
    monkeypatch.setattr(dc, "BLOCK_CHARS", 150)
    assert sorted(map(tuple, dc.leaks(rows, bench).select("doc_id", "item_id", "score").collect())) == whole and len(whole) == 5
    assert dc.leaks(docs_of([]), bench).count() == 0 and dc.leaks(rows, bench.limit(0)).count() == 0
    assert dc.clean(rows, bench.limit(0)).count() == rows.count()


def test_many_edited_copies_are_found_beside_one_whole_copy(spark, docs_of, words):
    item = words(40)
    own = item.split()
    own[19] = "elsewhere"
    copy = " ".join(own)
    rows = [(0, words(20) + " " + item)] + [(k, words(20) + " " + copy + " " + words(20)) for k in range(1, 31)] + [(k, words(20) + " " + " ".join(item.split()[:4]) + " " + words(20)) for k in range(50, 60)]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r.score for r in dc.leaks(docs_of(rows), bench).collect()}
    want = {d: brute_score(item, t) for d, t in rows}
    assert got == {d: s for d, s in want.items() if s >= dc.LEAST_SCORE} and len(got) == 31
    assert {r.doc_id for r in dc.clean(docs_of(rows), bench).collect()} == set(range(50, 60))


def test_short_items_are_found_whole(spark, docs_of, words):
    bench = spark.createDataFrame([(1, "Bohr's"), (2, "alpha beta gamma"), (3, "yes"), (None, "delta epsilon")], "item_id long, text string")
    rows = [(1, words(9) + " Alpha, beta gamma " + words(9)), (2, "alpha beta delta gamma"), (3, "Yes!"), (4, "a bohr s b"), (None, "delta. Epsilon"), (5, "epsilon delta")]
    assert {(r.doc_id, r.item_id) for r in dc.leaks(docs_of(rows), bench).collect()} == {(1, 2), (3, 3), (4, 1), (None, None)}
    assert {r.doc_id for r in dc.clean(docs_of(rows), bench).collect()} == {2, 5}


def test_frequent_grams_are_thinned(words):
    order = np.random.default_rng(3).permutation(60).tolist()
    often = {h: 1000 for h in order} | {order[7]: 900, order[20]: 3, order[40]: 100, order[42]: 40}
    got = dc.seeds(order, often, 20)
    assert {order[k] for k in (7, 20, 40, 42)} <= got and len(got) < 25
    assert all(got & set(order[k : k + dc.STRETCH]) for k in range(60 - dc.STRETCH + 1))
    assert dc.seeds([1, 2, 3], {}, 20) == set() and dc.seeds([1, 2, 3], {2: 5000, 3: 4000}, 20) == {3}


def test_recall_of_edited_copies_against_all_seeds(spark, docs_of, words, monkeypatch):
    """Items that are common in the corpus, so that nearly all their n-grams are thinned, and copies with one word in seven edited."""
    bench = [(k, words(30)) for k in range(20)]
    rows = [(k * 100 + c, words(10) + " " + (t if c < 25 else edited(t, 7, words)) + " " + words(10)) for k, t in bench for c in range(45)]
    bench, docs = spark.createDataFrame(bench, "item_id long, text string"), docs_of(rows)
    found = {(r.doc_id, r.item_id) for r in dc.leaks(docs, bench).collect()}
    monkeypatch.setattr(dc, "RARE_LEAST", 1 << 40)
    every = {(r.doc_id, r.item_id) for r in dc.leaks(docs, bench).collect()}
    assert found <= every and len(every) == 900 and len(found) >= 0.9 * len(every)
