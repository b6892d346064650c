import re

import pytest

from knowloom.llm import license_scan as ls

W = lambda text: re.findall(r"[^\W_]+", text.lower())


def brute(rows, templates=ls.TEMPLATES):
    out = {}
    for doc, text in rows:
        for name, template in templates.items():
            t, w = W(template), W(text or "")
            k = 5 if len(t) >= 5 else 3
            own = {tuple(t[j : j + k]) for j in range(len(t) - k + 1)}
            found = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
            for begin in range(0, len(found), len(own)):
                share = len(own & set(found[begin : begin + 2 * len(own)])) / len(own)
                if share >= ls.CONTAINED and share > out.get((doc, name), (0, 0))[0]:
                    out[doc, name] = (share, begin)
    return out


def test_bands_keep_their_promise():
    b = ls.bands_for(0.8, 1e-3)
    assert (1 - 0.8 / 2.2) ** b <= 1e-3 < (1 - 0.8 / 2.2) ** (b - 1)


def test_equals_brute_force(docs_of, words):
    mit, gpl, apache = ls.TEMPLATES["MIT-text"], ls.TEMPLATES["GPL-3.0"], ls.TEMPLATES["Apache-2.0-header"]
    cut = " ".join(mit.split()[:-8])
    changed = mit.replace("restriction", "limits")
    half = " ".join(mit.split()[:30])
    rows = [(k, words(60)) for k in range(20)] + [
        (30, words(40) + " " + mit + " " + words(11)), (31, cut), (32, words(3) + " " + changed), (33, half), (34, gpl.upper().replace(" ", "\n- ")), (35, words(7000) + ". " + apache + " " + words(9) + " All rights, reserved!"),
        (36, None), (37, ""), (38, "all rights"), (39, "All rights reserved"), (40, gpl + " " + gpl), (None, gpl), (41, "released under the mit license"), (41, "Released under the MIT License."),
    ]
    got = ls.scan(docs_of(rows, ", template long, n long")).collect()
    assert {(r.doc_id, r.template): (r.containment, r.first_word) for r in got} == brute(rows)
    assert len(got) == len({(r.doc_id, r.template) for r in got})


def test_main_path_is_native(docs_of):
    plan = ls.scan(docs_of([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table_and_bad_lists(docs_of):
    assert ls.scan(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        ls.scan(docs_of([(1, "x")]), {"short": "two words"})
