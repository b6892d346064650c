import pytest

from knowloom.llm import unit_dedup as ud
from llm_brute import brute_units

PASSAGE = "Rivers carry the snow down to the sea. Farmers wait for the warm wind to come! Then the fields are ploughed and sown again.\n"
SHORT = "It rained.\nNobody came.\nThey waited under the roof.\nThe dog slept.\nThe rain went on until the evening and then it stopped.\n"
HAN = "河水在夜里上涨到了早晨低处的田地都在水下所以农民把牲畜赶到旧采石场在那里等雨停下来没有人记得有过这样的洪水他们都在等待"


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_earliest_stays_and_offsets_are_kept(docs_of, words):
    rows = [(3, "Head three is not the same.\n" + PASSAGE + "Tail three differs from all."), (1, "First words of one are its own.\n" + PASSAGE), (2, "A short line.\n" + PASSAGE.upper() + "A short line.\n")]
    rows += [(k, "This line is shared by many documents here.\n" + words(30) + ".\n" + ("" if k % 3 else PASSAGE) + ("\n" + SHORT + "\n" if k % 4 == 0 else "") + words(12)) for k in range(10, 40)]
    rows += [(50, words(20_000) + ".\n" + PASSAGE), (51, PASSAGE + PASSAGE + "\n" + SHORT + "\n \n" + SHORT)]
    got, want = rows_of(ud.dedup(docs_of(rows))), brute_units(rows, ud)
    for doc, _ in rows:
        assert (got[doc].text, [(s.start, s.end) for s in got[doc].removed]) == want[doc]
        assert got[doc].n_chars == len(want[doc][0])
    assert PASSAGE in got[1].text and got[3].text == "Head three is not the same.\nTail three differs from all."
    assert all("shared by many" in got[k].text for k in range(10, 40)) and sum(SHORT in got[k].text for k in range(10, 40)) == 1


@pytest.mark.parametrize("text", [SHORT, SHORT.replace("\n", " ").strip(), HAN, "\n\n" + HAN[:20] + "\n" + HAN[20:], PASSAGE])
def test_a_copy_goes_whole(docs_of, text):
    got = rows_of(ud.dedup(docs_of([(1, text), (2, text), (3, "before\n\n" + text)])))
    assert (got[1].text, got[2].text) == (text, "\n\n" if text.startswith("\n") else "") and got[3].text.strip() == "before"


def test_a_short_line_alone_stays(docs_of):
    got = rows_of(ud.dedup(docs_of([(k, f"Number {k} says:\nIt rained.\nAll rights reserved by the owner of this page.\n\nIt rained.") for k in range(5)])))
    assert all(not r.removed for r in got.values())


def test_nulls_empties_copies_and_names(docs_of):
    rows = [(1, PASSAGE), (2, PASSAGE), (3, None), (4, ""), (None, PASSAGE), (5, "short. short. short."), (6, PASSAGE.replace("sea", "See") * 2)]
    docs = docs_of(rows, ", removed long, version_of_text long")
    out = ud.dedup(docs)
    assert out.columns == [*docs.columns, "removed_1"]
    got = rows_of(out)
    assert (got[1].text, got[2].text, got[None].text) == (PASSAGE, "", "")
    assert got[3].text is None and got[4].text == "" and not got[3].removed_1 and got[5].text == rows[5][1]
    assert got[6].text == PASSAGE.replace("sea", "See") and got[6].removed == 7


def test_repeated_rows_stay_equal(docs_of):
    got = ud.dedup(docs_of([(1, PASSAGE), (1, PASSAGE), (0, "Nothing of this is said again anywhere.")])).where("doc_id = 1").collect()
    assert [r.text for r in got] == [PASSAGE, PASSAGE]
    assert ud.dedup(docs_of([])).count() == 0
