import html
import html.parser

import numpy as np
import pytest

from knowloom.llm import host_reputation as hr, html_blocks as hb
from knowloom.llm.catalog import URL_RULES

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def tree(spark):
    return hb.train(hb.labelled(spark))


def test_examples_are_learned(tree):
    for page, labels in hb.EXAMPLES:
        found = hb.blocks(page)
        assert ((hb.judge(tree, hb.features(found)) >= 0.5) == np.array(labels)).all()


def test_tree_splits_like_a_plain_search():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (60, 3)).astype(float)
    y = ((x[:, 1] > 2) & (x[:, 0] <= 3)).astype(float)
    assert ((hb.judge(hb.grow(x, y), x) >= 0.5) == y).all()
    assert hb.grow(x[:0], y[:0]) == (0.0,) and hb.grow(x, y * 0) == (0.0,)


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<!-- only a note -->", ""),
        ("<article><p>foo<b>bar</b>  baz<br>q&amp;x &lt;i&gt;\n\u00a0z</p><script>var x='<p>no</p>'</script><p>end", "foobar baz q&x <i> z end"),
        ("<body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>And.</p></article><footer>&copy; us</footer>", "T And."),
        ("<nav><p>Only a menu here and no article at all</p></nav>", ""),
        ("<article><p>a < b and c</p><!-- x --><style>p{}</style><p title='>'>d</p></article>", "a < b and c d"),
        ("<article><p>One two.</p><div class='comments'><p>A reader says so</p></div><aside>More</aside><form>Name</form><p>Three.</p></article>", "One two. Three."),
        ("<article><p>" + "word " * 30_000 + "</p></article>", ("word " * 30_000).strip()),
    ],
)
def test_main_text(tree, page, text):
    assert hb.main_text(page, tree) == text


def test_given_pages_give_their_articles(spark, sf_dir, tree):
    import re

    for row in hb.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), tree).collect():
        own = row.html[row.html.index("<article>") + 9 :].split("</article>")[0].split("<footer")[0]
        assert row.text == " ".join(" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]*>", own) if x.strip())


def test_extract_rows(spark, tree):
    pages = spark.createDataFrame([(1, None, None, 5), (1, None, None, 5), (2, "u", "<p>x", 6)], PAGES + ", text long")
    out = hb.extract(pages, tree)
    assert out.columns == [*pages.columns, "text_1"] and [r.text_1 for r in out.orderBy("page_id").collect()][:2] == ["", ""]
    assert hb.extract(pages.limit(0), tree).count() == 0


def test_rules_and_parts(spark):
    urls = {
        None: ("", "", None), "no scheme.com/en/": ("", "", None), "http://": ("", "", None),
        "https://WWW.Example.com/en/1?q#f": ("www.example.com", "/en/1", "www.example.com/en/"), "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/"),
        "http://example.com/EN/": ("example.com", "/EN/", "com/"), "http://b.net/es/x": ("b.net", "/es/x", "net/es/"), "http://c.com": ("c.com", "", None), "http://telecom/x": ("telecom", "/x", None),
        "http://É.COM/fr/://x/y": ("É.com", "/fr/://x/y", "com/"), "a://b://c/d": ("b:", "//c/d", None), "http://x.net\n/fr/": ("x.net\n", "/fr/", None),
    }
    pages = spark.createDataFrame([(k, u, 1, 2) for k, u in enumerate(urls)], "page_id long, url string, host long, verdict long")
    out = hr.judge(pages, URL_RULES)
    assert out.columns == [*pages.columns, "host_1", "path", "rule", "verdict_1", "low"]
    for row in out.collect():
        assert (row.host_1, row.path, row.rule) == urls[row.url], row
        assert row.verdict_1 in ("allow", "block") and (row.low is None) == (row.rule is not None)


def plain_posterior(rows):
    """The same model in plain Python: rows of (host, bad or None)."""
    hosts = {}
    for host, bad in rows:
        n, k = hosts.get(host, (0, 0))
        hosts[host] = (n + (bad is not None), k + bool(bad))
    def total(keys):
        out = {}
        for h, (n, k) in hosts.items():
            a, b = out.get(keys(h), (0, 0))
            out[keys(h)] = (a + n, b + k)
        return out
    def strength(level, mean):
        m = {x: mean(x) for x in level}
        miss = sum((k - n * m[x]) ** 2 for x, (n, k) in level.items())
        spread = sum(n * m[x] * (1 - m[x]) for x, (n, k) in level.items())
        pairs = sum(n * (n - 1) * m[x] * (1 - m[x]) for x, (n, k) in level.items())
        groups = sum(1 for n, _ in level.values() if n)
        r = min(0.999, max(0.001, 1 / (groups + 1), (miss - spread) / pairs if pairs > 0 else 0.5))
        return (1 - r) / r
    n, k = sum(n for n, _ in hosts.values()) + 2, sum(k for _, k in hosts.values()) + 1
    above = lambda x: (k / n, k / n * (1 - k / n) / (n + 1))
    labels = lambda h: 2 if h.count(".") > 1 and ".".join(h.split(".")[-2:]) in hr.SUFFIXES else 1
    domain, suffix = (lambda h: ".".join(h.split(".")[-1 - labels(h) :])), (lambda h: ".".join(h.split(".")[-labels(h) :]))
    known = {s for s, (n, _) in total(suffix).items() if n}
    over = {domain(h): suffix(h) for h in hosts}
    for keys, up in ((suffix, lambda x: None), (domain, over.get), (lambda h: h, domain)):
        level = total(keys)
        parent = {x: above(up(x)) for x in level}
        s = strength(level, lambda x: parent[x][0])
        new = {}
        for x, (c, b) in level.items():
            m = (b + s * parent[x][0]) / (c + s)
            new[x] = (m, m * (1 - m) / (c + s + 1) + (s / (c + s)) ** 2 * parent[x][1])
        above = new.__getitem__
    return {h: (above(h)[0], above(h)[0] - hr.BOUND * above(h)[1] ** 0.5 if suffix(h) in known else 0) for h in hosts}


def test_reputation_equals_the_plain_model(spark):
    rng = np.random.default_rng(8)
    rows = []
    for d in range(12):
        rate = rng.beta(1, 2)
        for h in range(5):
            host = f"h{h}.d{d}.s{d % 3}"
            rows += [(host, None if rng.random() < 0.3 else bool(rng.random() < rate)) for _ in range(int(rng.integers(1, 30)))]
    rows += [("new.one.zz", None), ("h0.d0.s0", True), ("www.a.co.uk", True), ("b.co.uk", None), ("co.uk", False), ("x.github.io", True), ("10.0.0.1:80", None)]
    want = plain_posterior(rows)
    got = hr.reputations(spark.createDataFrame(rows, "host string, bad boolean")).collect()
    assert {r.host for r in got} == set(want)
    assert all(abs(r["mean"] - want[r.host][0]) < 1e-12 and abs(r.low - want[r.host][1]) < 1e-12 for r in got)
    low = {r.host: r.low for r in got}
    assert low["new.one.zz"] == 0 and low["b.co.uk"] < low["www.a.co.uk"]


def test_suffixes_of_none_mixed_and_bad_outcomes(spark, sf_dir):
    rows = [(f"h{k % 7}.bad", True) for k in range(60)] + [(f"h{k % 7}.mixed", k % 2 == 0) for k in range(60)] + [(h, None) for h in ("new.bad", "new.mixed", "new.none", "h1.none")]
    low = {r.host: r.low for r in hr.reputations(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    assert low["h1.bad"] > hr.THRESHOLD > max(low["new.mixed"], low["h1.mixed"]) and low["new.none"] == low["h1.none"] == 0
    pages = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/pages.parquet")
    judged = hr.judge(pages, URL_RULES).where("rule is null")
    assert {r.verdict for r in judged.select("verdict").distinct().collect()} == {"allow", "block"}
    assert judged.where("host like '%.org' and verdict = 'block'").count() == 0


def test_no_outcomes_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in hr.judge(pages, []).collect()} == {"allow"}
    assert hr.judge(pages.limit(0), URL_RULES).count() == 0
    with pytest.raises(ValueError):
        hr.judge(pages, [("x/", "allow")] * 501)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>By <span class='tags'>news</span> Anna.</p><p>One two.</p><p>Three.</p></article>", "By Anna. One two. Three."),
        ("<article><p>a <span class=share>x <span>y</span> z</span> b</p><p>c</p></article>", "a b c"),
        ("<article><p>a<span class=big>b</span>c</p><p><span class=ad>x</p><p>d</p></article>", "abc d"),
        ("<article><p>a</p><svg width=1 /><p>b</p><math/><p>c</p><svg><text>no</text></svg><p>d</p></article>", "a b c d"),
        ("<article><button-bar>a</button-bar><p>b</p><select-box><p>c</p></select-box></article>", "a b c"),
    ],
)
def test_spans_and_self_closed_elements_end(tree, page, text):
    assert hb.main_text(page, tree) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ('<div class="page no-sidebar"><article><p>One two.</p><p>Three.</p></article></div>', "One two. Three."),
        ('<div class="site header-fixed"><main><p>One.</p></main></div>', "One."),
        ('<body class="has-sidebar with-footer"><div class="with-menu"><article><p>One.</p></article><div class=sidebar><p>Two three four.</p></div></div></body>', "One."),
        ("<form><article><p>One.</p></article><p>Your name</p></form>", "One."),
        ("<div class=header><p>Valley News, since 1900.</p><div class=post-content><p>One.</p></div></div>", "One."),
        ("<article><p>One.</p></article><section id=comments><article><p>A reader says so, and says a lot of it.</p></article></section>", "One."),
        ("<aside><article><p>Another story, told at some length here.</p></article></aside><main><p>One.</p></main>", "One."),
        ("<article><p>One.</p><article class='comment-body'><p>A reader says so.</p></article></article>", "One."),
    ],
)
def test_articles_win_below_wrappers_of_the_page(tree, page, text):
    assert hb.main_text(page, tree) == text


def test_html_may_stay_behind(spark, tree):
    pages = spark.createDataFrame([(1, "u", "<article><p>x</p></article>")], PAGES)
    assert hb.extract(pages, tree, html_too=False).collect() == [(1, "u", "x")]


class Twin(html.parser.HTMLParser):
    """Blocks of well-formed pages by the standard library's parser: texts, words and words in links."""

    def __init__(self, page):
        super().__init__()
        self.out, self.run, self.links, self.deep, self.hidden = [], "", "", 0, 0
        self.feed(page)
        self.cut()

    def cut(self):
        if text := " ".join(self.run.split()):
            self.out.append((text, len(text.split()), min(1.0, len(self.links.split()) / len(text.split()))))
        self.run = self.links = ""

    def handle_starttag(self, tag, attrs):
        if tag in hb.HIDDEN.split("|"):
            self.hidden += 1
        elif tag not in hb.INLINE:
            self.cut()
        self.deep += tag == "a"

    def handle_endtag(self, tag):
        if tag in hb.HIDDEN.split("|"):
            self.hidden -= 1
        elif tag not in hb.INLINE:
            self.cut()
        self.deep -= tag == "a"

    def handle_data(self, data):
        if not self.hidden:
            self.run += data
            self.links += (data + " ") * bool(self.deep)


def test_blocks_equal_another_parsers(spark, sf_dir):
    import random

    rng = random.Random(7)

    def made(deep):
        kind = rng.choice(["p", "div", "b", "a", "ul", "li", "h2", "em", "script", "section", "text", "text", "br"])
        if kind == "text" or deep > 4:
            return rng.choice(["one two ", "x &amp; y ", "\n", "three", " a &lt; b ", "<!-- no -->"])
        if kind == "br":
            return "<br>"
        inside = "" if kind == "script" else "".join(made(deep + (kind != "a" and 1 or 9)) for _ in range(rng.randint(0, 4)))
        return f"<{kind} title='a>b'>{inside}</{kind}>"

    pages = ["<body>" + "".join(made(0) for _ in range(6)) + "</body>" for _ in range(300)]
    pages += [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    for page in pages:
        assert [(b.text, b.words, b.links) for b in hb.blocks(page)] == Twin(page).out, page
