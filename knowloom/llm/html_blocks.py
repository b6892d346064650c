"""Main text of web pages from flat text blocks.

A page is read once as a flat run of blocks: text between block-level tags. Each block has the number of
its words and its link density, those of the block before and after, the kind of part it stands in and what its part is called.
A decision tree, trained on a small labelled table of such blocks, says which blocks are the article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from knowloom.llm.html_examples import EXAMPLES
from knowloom.llm.shared import free_name, slices

#: Elements whose content is never text of the page.
HIDDEN = "script|style|noscript|template|textarea|select|svg|math|iframe|object|canvas|title|button|datalist"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:svg|math)(?=[\s/>])(?:[^>\"'/]|/(?!>)|\"[^\"]*\"|'[^']*')*+/>"
    rf"|<({HIDDEN})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
#: Elements that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose text is no part of an article, and elements that hold one.
OUTSIDE = frozenset("nav header footer aside form menu dialog head fieldset".split())
WITHIN = frozenset("article main".split())
#: Elements that may name their part by class, id or role.
NAMED = frozenset("div section ul ol table p span dl".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that name a part outside the article, and one that holds it.
OUTSIDE_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|sponsor(?:ed)?|promos?|banner|cookies?|consent|gdpr|notices?|alert|nav(?:bar|igation)?|menus?|breadcrumbs?|sidebar|side|footer|foot|header|masthead|top-?bar|comments?|disqus|replies|respond|related|recommended|share|sharing|social|newsletter|subscribe|signup|login|search|popup|modal|overlay|widget|toc|pagination|pager|tags?|copyright|legal|disclaimer|contentinfo|complementary)(?:$|[\s_-])", re.I)
WITHIN_NAME = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|body|main|text)(?:$|[\s_-])", re.I)
#: Of the outside names, those below which an article element is one of other articles or a reader's.
CLOSED_NAME = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|replies|respond|related|recommended|sidebar|side|widget|ads?|adverts?|advertisements?|adsense|sponsor(?:ed)?|promos?|complementary)(?:$|[\s_-])", re.I)
#: Names of the article's own text, which hold it also below another outside name.
OWN_NAME = re.compile(r"(?:^|\s)(?:(?:article|post|entry|story)[_-]?(?:content|body|text)|main[_-]content)(?:$|\s)", re.I)
#: Classes that tell how a page is laid out and name no part: a state before or after the word.
LAYOUT = re.compile(r"(?:^|\s)(?:(?:no|has|with|without|is|not|hide|show|hidden)[_-]\S*|\S*[_-](?:fixed|sticky|enabled|disabled|visible|hidden|active|open|opened|closed|collapsed|expanded|on|off|layout|page))(?=$|\s)", re.I)
LABEL = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

#: Columns of a block's features, in order.
FEATURES = ("part", "named", "words", "links", "words_before", "links_before", "words_after", "links_after", "heading")


@dataclass
class Block:
    text: str
    words: int
    links: float  # share of its words that stand in links
    part: int  # by elements: 1 in an article, -1 in a form, -2 in another part outside it, 0 in neither
    named: int  # by names: 1 in a part that holds it, -1 in one outside it, -2 in one of other articles or readers, 0 in neither
    heading: bool


def blocks(page: str) -> list[Block]:
    """All text blocks of a page in order, with references decoded and white space made one space; parts may be left open."""
    out: list[Block] = []
    parts: list[tuple[str, tuple[int, int]]] = []
    spans = 0  # open parts when the open paragraph began
    run: list[str] = []
    linked, in_link, heading = [], 0, False

    def close() -> None:
        nonlocal run, linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                words = text.count(" ") + 1
                out.append(Block(text, words, min(1.0, len(" ".join(linked).split()) / words), *(parts[-1][1] if parts else NOWHERE), heading))
            run, linked = [], []

    for m in TOKEN.finditer(page):
        name = m[3] or m[6]
        if name is None:
            if m[1] is None and m[0][0] != "<" or m[0] == "<":
                text = html.unescape(m[0]) if "&" in m[0] else m[0]
                run.append(text)
                if in_link:
                    linked.append(text)
            elif m[0].startswith("<![CDATA["):
                run.append(m[0][9:-3])
            continue
        name, ends, attributes = name.lower(), bool(m[2] or m[5]), m[4] or m[7] or ""
        if name == "a":
            in_link = 0 if ends else 1
        if name == "span":
            if ends and parts and parts[-1][0] == "span":
                if parts[-1][1] != (parts[-2][1] if len(parts) > 1 else NOWHERE):
                    close()
                parts.pop()
            elif not ends and not attributes.endswith("/"):
                over = parts[-1][1] if parts else NOWHERE
                part = _part(name, attributes, over)
                if part != over:
                    close()
                parts.append((name, part))
            continue
        if name in INLINE:
            continue
        close()
        if name == "p":
            while len(parts) > spans and parts[-1][0] == "span":  # left open in the paragraph before
                parts.pop()
            spans = len(parts)
        if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = not ends
        if name in VOID or attributes.endswith("/"):
            continue
        if name in OUTSIDE or name in WITHIN or name in NAMED:
            if ends:
                for k in range(len(parts) - 1, -1, -1):
                    if parts[k][0] == name:
                        del parts[k:]
                        break
                    if name == "p":
                        break
            elif name != "p":
                parts.append((name, _part(name, attributes, parts[-1][1] if parts else NOWHERE)))
    close()
    return out


NOWHERE = (0, 0)


def _part(name: str, attributes: str, over: tuple[int, int]) -> tuple[int, int]:
    """``part`` and ``named`` below an element; an article or its own text wins below a form and below names of the page's frame."""
    part, named = over
    if part == -2:
        return over
    if name in OUTSIDE:
        return (-1 if name == "form" else -2), named
    label = LAYOUT.sub(" ", " ".join(a or b or c for a, b, c in LABEL.findall(attributes)))
    outside = OUTSIDE_NAME.search(label) if label.strip() else None
    if name in WITHIN and not outside and (named > -2 or name == "main"):
        return 1, 0
    if label and OWN_NAME.search(label) and named > -2:
        return max(part, 0), 1
    if outside:
        return part, min(named, -2 if CLOSED_NAME.search(label) else -1)
    if label and named >= 0 and WITHIN_NAME.search(label):
        return part, 1
    return over


def features(found: list[Block]) -> np.ndarray:
    """One row of FEATURES for each block; a missing neighbour has no words and no links."""
    own = np.array([(b.words, b.links) for b in found], float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    before, after = np.concatenate([edge, own[:-1]])[: len(own)], np.concatenate([own[1:], edge])[: len(own)]
    part, heading = np.array([(b.part, b.named) for b in found], float).reshape(-1, 2), np.array([[b.heading] for b in found], float).reshape(-1, 1)
    return np.concatenate([part, own, before, after, heading], axis=1)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1) -> tuple:
    """A decision tree by Gini impurity: ``(share,)`` or ``(feature, limit, below or equal, above)``; ties take the first feature and lowest limit."""
    share = float(y.mean()) if len(y) else 0.0
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return (share,)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        for k in np.flatnonzero(v[1:] > v[:-1]) + 1:
            if least <= k <= len(y) - least:
                p, q = ones[k - 1] / k, (ones[-1] - ones[k - 1]) / (len(y) - k)
                cost = k * p * (1 - p) + (len(y) - k) * q * (1 - q)
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, (v[k] + v[k - 1]) / 2)
    if best is None or best[0] > len(y) * share * (1 - share) - 1e-9:
        return (share,)
    _, f, limit = best
    low = x[:, f] <= limit
    return (f, float(limit), grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def judge(tree: tuple, x: np.ndarray) -> np.ndarray:
    """The share of article blocks in each row's leaf."""
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    f, limit, low, high = tree
    out, below = np.empty(len(x)), x[:, f] <= limit
    out[below], out[~below] = judge(low, x[below]), judge(high, x[~below])
    return out


def labelled(spark: SparkSession) -> DataFrame:
    """The labelled table: FEATURES and ``label`` of every block of the example pages."""
    rows = [(*map(float, row), label) for page, labels in EXAMPLES for row, label in zip(features(blocks(page)).tolist(), labels, strict=True)]
    return spark.createDataFrame(rows, ", ".join(f"{f} double" for f in FEATURES) + ", label int")


def train(table: DataFrame, most: int = 10_000) -> tuple:
    """The tree of a labelled table of blocks. The table is small by contract: more than ``most`` rows are refused."""
    rows = table.select(*FEATURES, "label").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a labelled table has at most {most} rows")
    rows = np.array(sorted(map(tuple, rows)), float).reshape(-1, len(FEATURES) + 1)
    return grow(rows[:, :-1], rows[:, -1])


def main_text(page: str | None, tree: tuple) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return " ".join(b.text for b, p in zip(found, judge(tree, features(found))) if p >= 0.5)


def extract(pages: DataFrame, tree: tuple, text: str = "text", html_too: bool = True) -> DataFrame:
    """``pages`` with ``text``: the article's blocks in page order, joined by one space; empty if there are none.

    Without ``html_too`` the column ``html`` is left out, so that it need not come back from the Python workers.

    The whole html is read, however long; null and empty html give an empty text, and so does a page of other parts
    only. Broken and unclosed markup is taken as it comes. Repeated rows give equal texts, other columns stay, a clash
    of names moves the new column to ``text_1`` and so on, an empty table gives no rows.
    """
    text = free_name(pages, text)
    at = pages.columns.index("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [main_text(x.as_py(), tree) for x in batch.column(at)]
            kept = [k for k in range(batch.num_columns) if html_too or k != at]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(made, pa.string())], names=[*[batch.schema.names[k] for k in kept], text])

    fields = [f for k, f in enumerate(pages.schema.fields) if html_too or k != at]
    return pages.mapInArrow(run, T.StructType(fields).add(text, T.StringType()))
