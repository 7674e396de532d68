"""Main text of web pages: flat text blocks and a decision tree.

A page is cut into text blocks at block-level tags. Each block has its word
count and link density, those of the block before and after, and whether the
tags around it name an article, a heading or page furniture. A small decision
tree (Gini impurity), trained on the labelled table below, keeps or drops it.

Defined cases. A null or empty page has the empty text. Character references
are decoded, white space inside a block becomes one space, ``<br>`` counts as
white space; unclosed and stray tags are tolerated. Repeated rows each give a
row. Extra columns are ignored. No page is cut short.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_HINT = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s*=\s*\"\"|(?=[\s/]|$))|(?:^|\s)aria-hidden\s*=\s*(?:\"\"|true)", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_NO_DISPLAY = re.compile(r"style\s*=\s*[\"'][^\"']*display\s*:\s*none|aria-hidden\s*=\s*[\"']true", re.I)
#: Class names that say what a block has or is like, not what it is.
_STATE = re.compile(r"(?:has|with|without|no|is|show|hide)-")
_FURNITURE = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adverti[sz]ement|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|side-?bar|widget|related|recommend\w*|share|sharing|social|comments?|discussions?|replies|disqus|respond|subscribe|newsletter|signup|login|search|pagination|pager|tags?-list|copyright|legal|toolbar|complementary|contentinfo|navigation)(?:[^a-z]|$)"
)
_MAIN = re.compile(r"(?:^|[^a-z])(?:article|post|entry|story|main|content)(?:-?(?:body|content|text))?(?:[^a-z]|$)")
# fixed values: HTML element names by their role
SILENT = {"script", "style", "template", "noscript", "svg", "iframe", "object", "textarea", "select", "canvas", "video", "audio", "math"}
CONTAINERS = {"html", "head", "body", "nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "ul", "ol", "dl", "table", "figure", "details", "dialog", "menu", "fieldset", "blockquote", "button", "address", "title"}
FURNITURE_TAGS = {"nav", "header", "footer", "aside", "form", "head", "menu", "dialog", "fieldset", "button", "title"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = CONTAINERS | HEADINGS | {"p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "figcaption", "pre", "hr", "legend", "summary", "option", "label", "center", "meta", "link"}

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "article", "heading")
#: The labelled table: features of blocks in the order of FEATURES, then 1 for main text.
LABELLED = """
6 1 0 0 1 1 1 0 0 0
1 1 6 1 1 1 1 0 0 0
1 1 1 1 1 1 1 0 0 0
2 1 1 1 9 0 1 0 0 0
9 0 1 1 12 0 1 0 0 0
8 0 1 1 10 0 1 0 0 0
12 0 9 0 55 0 0 1 1 1
5 0 8 0 40 0 0 1 1 1
1 0 8 0 3 0 0 1 1 1
40 0 5 0 80 0 0 1 0 1
80 0 40 0 3 0 0 1 0 1
3 0 80 0 61 0 0 1 0 1
1 0 61 0 55 0 0 1 0 1
61 0.1 3 0 9 0 0 1 0 1
25 0.3 61 0 4 1 0 1 0 1
1 0 30 0 9 0 0 1 0 1
9 0 61 0 0 0 1 0 0 0
14 0 55 0 0 0 1 0 0 0
60 0 40 0 30 0 1 0 0 0
35 0 60 0 22 0 1 1 0 0
22 0 35 0 9 0 1 1 0 0
4 0 80 0 20 0 1 1 1 0
18 0.2 90 0 3 1 1 1 0 0
3 1 70 0 3 1 1 1 0 0
5 1 55 0 5 1 0 1 0 0
4 1 5 1 80 0 0 1 0 0
1 1 40 0 1 1 0 1 0 0
3 1 3 1 3 1 0 0 0 0
2 1 30 0 2 1 0 0 0 0
5 0.9 4 1 4 1 0 0 0 0
4 0 3 1 5 1 0 0 0 0
7 0 3 1 2 1 0 0 0 0
3 0 0 0 2 1 0 0 0 0
2 0 2 0 3 1 0 0 0 0
5 0 55 0 0 0 0 0 0 0
6 0.5 40 0 0 0 0 0 0 0
45 0 6 0 60 0 0 0 0 1
60 0.05 45 0 30 0 0 0 0 1
30 0 60 0 50 0 0 0 0 1
20 0 3 1 44 0 0 0 0 1
17 0 44 0 4 0 0 0 0 1
15 0.1 50 0 60 0 0 0 0 1
7 0 3 1 48 0 0 0 1 1
5 0 60 0 41 0 0 0 1 1
3 0 2 1 2 1 0 0 1 0
2 1 30 0 3 1 0 0 1 0
8 0 40 0 52 0 0 0 0 1
6 0 33 0 47 0 0 0 0 1
28 0.8 5 0.9 6 1 0 0 0 0
16 0.7 40 0 3 1 0 0 0 0
33 0 0 0 3 1 1 0 0 0
2 0 12 0 70 0 1 1 0 0
"""


def grow(x: np.ndarray, y: np.ndarray, depth: int) -> dict:
    """A decision tree by the largest fall in Gini impurity."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return {"keep": share >= 0.5}
    best = (len(y) * share * (1 - share), None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= cut
            a, b = y[left].mean(), y[~left].mean()
            impurity = left.sum() * a * (1 - a) + (~left).sum() * b * (1 - b)
            if impurity < best[0] - 1e-9:
                best = (impurity, f, float(cut))
    if best[1] is None:
        return {"keep": share >= 0.5}
    left = x[:, best[1]] <= best[2]
    return {"feature": best[1], "cut": best[2], "low": grow(x[left], y[left], depth - 1), "high": grow(x[~left], y[~left], depth - 1)}


def trained(table: str = LABELLED, depth: int = 6) -> dict:
    rows = np.array([r.split() for r in table.strip().splitlines()], float)
    # where tags name an article or furniture, a label holds at any size of the block and its neighbours
    named = rows[(rows[:, 6] + rows[:, 7] > 0) & (rows[:, 1] < 0.5)]
    around = [(1, 9, 0, 60, 0), (200, 1, 1, 1, 1), (9, 120, 0, 9, 1), (30, 2, 0, 300, 0), (2, 30, 0, 1, 1), (60, 3, 1, 0, 0), (4, 0, 0, 0, 0), (12, 40, 0.3, 6, 1)]
    varied = np.repeat(named, len(around), axis=0)
    varied[:, [0, 2, 3, 4, 5]] = np.tile(np.array(around, float), (len(named), 1))
    rows = np.concatenate([rows, varied])
    return grow(rows[:, :-1], rows[:, -1], depth)


def keeps(tree: dict, features: tuple) -> bool:
    while "keep" not in tree:
        tree = tree["low"] if features[tree["feature"]] <= tree["cut"] else tree["high"]
    return tree["keep"]


def hidden(attributes: str) -> bool:
    """Whether the attributes hide an element: ``hidden`` itself, not a value that says so of something else."""
    return bool(_HIDDEN.search(_QUOTED.sub('""', attributes)) or _NO_DISPLAY.search(attributes))


def blocks(page: str) -> list[tuple[str, float, bool, bool, bool]]:
    """``text, link density, furniture, article, heading`` of each text block."""
    out, parts = [], []
    stack: list[tuple[str, bool, bool, bool]] = []  # and whether only a class name says furniture
    begun = False  # the first article or main element
    inside = [0, 0]  # open elements that are furniture, and that name an article
    linked = in_link = 0
    heading = False
    at, n = 0, len(page)

    def close() -> None:
        nonlocal linked
        text = " ".join(references.unescape("".join(parts)).split()) if parts else ""
        if text:
            size = sum(len(p.strip()) for p in parts) or 1
            out.append((text, min(1.0, linked / size), inside[0] > 0, inside[1] > 0, heading))
        parts.clear()
        linked = 0

    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            parts.append(text)
            linked += len(text.strip()) if in_link else 0
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in SILENT:
            if not closing and not m[0].endswith("/>"):
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            parts.append(" ")
        elif name == "a":
            in_link = 0 if closing else 1
        elif name == "br":
            parts.append(" ")
        elif name in BLOCKS:
            close()
            in_link = 0
            if name in HEADINGS:
                heading = not closing
            elif name in CONTAINERS:
                heading = False
                if closing:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == name:
                            inside[0] -= sum(s[1] for s in stack[i:])
                            inside[1] -= sum(s[2] for s in stack[i:])
                            del stack[i:]
                            break
                else:
                    hint = " ".join(x for h in _HINT.findall(m[3] or "") for x in h.strip("\"'").lower().split() if not _STATE.match(x))
                    surely = name in FURNITURE_TAGS or hidden(m[3] or "")
                    main = name in ("article", "main")
                    if main and not begun and not surely:
                        # what holds the page's article is its layout, whatever its classes are called
                        begun = True
                        inside[0] -= sum(s[3] for s in stack)
                        stack = [(t, f and not by_name, a, False) for t, f, a, by_name in stack]
                    by_name = not surely and not main and name not in ("body", "html") and bool(_FURNITURE.search(hint))
                    stack.append((name, surely or by_name, main or bool(_MAIN.search(hint)), by_name))
                    inside[0] += stack[-1][1]
                    inside[1] += stack[-1][2]
    close()
    return out


def main_text(page: str | None, tree: dict) -> str:
    found = blocks(page or "")
    shape = [(0, 0.0), *[(len(b[0].split()), b[1]) for b in found], (0, 0.0)]
    kept = []
    for i, (text, _, furniture, article, heading) in enumerate(found, 1):
        if keeps(tree, (*shape[i], *shape[i - 1], *shape[i + 1], furniture, article, heading)):
            kept.append(text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, html: str = "html", depth: int = 6) -> DataFrame:
    """``page_id, url, text`` of every page."""
    tree = trained(depth=depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                b = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(h.as_py(), tree) for h in b.column(2)], pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col(html).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")
