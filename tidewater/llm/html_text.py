"""Main text of web pages: flat text blocks, judged by a decision tree on their and their neighbours' shallow features.

A page becomes a list of text blocks.  Each has its word count and link density, those of the blocks before and after it,
and whether it stands in an article and in a container for other things (by tag, class, id or role).  The tree is grown on
LABELLED, a small table of typical blocks.

Defined results: null and empty html, and pages without main text, give the empty string; broken markup is read as far as it
goes; pages of any length are read whole; repeated rows repeat their result; an empty table gives no rows; columns named
like the results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.session import ship

SKIP = frozenset("head title script style noscript template textarea select option button iframe svg math object canvas audio video".split())
OUTSIDE = frozenset("nav footer aside form menu dialog".split())
#: Of these, those that do not end the block around them.
UNSEEN = frozenset("script style noscript template".split())
INSIDE = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
BOILER = re.compile(
    r"(?<![a-z])(ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|sidebar|footer|masthead|site-?header|page-?header|cookies?|consent|notice|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|comments?|disqus|replies|respond|toolbar|pagination|widget|legal|copyright)(?![a-z])",
    re.I,
)

FEATURES = ("in_article", "boiler", "words", "links", "words_before", "links_before", "words_after", "links_after")
#: Typical blocks by hand: the features in this order, then 1 for main text.
LABELLED = (
    (1, 0, 120, 0.0, 80, 0.0, 60, 0.0, 1), (1, 0, 40, 0.1, 8, 0.0, 90, 0.0, 1), (1, 0, 2, 0.0, 60, 0.0, 45, 0.0, 1), (1, 0, 7, 0.0, 8, 0.0, 70, 0.0, 1), (1, 0, 1, 0.0, 0, 0.0, 0, 0.0, 1),
    (1, 0, 3, 1.0, 70, 0.0, 20, 0.0, 1), (1, 0, 15, 0.5, 30, 0.0, 30, 0.1, 1), (1, 0, 300, 0.0, 1, 1.0, 10, 0.0, 1), (1, 0, 4, 0.0, 1, 1.0, 2, 0.0, 1), (1, 0, 9, 0.0, 12, 0.0, 11, 0.0, 1),
    (1, 1, 12, 0.0, 80, 0.0, 30, 0.0, 0), (1, 1, 4, 1.0, 60, 0.0, 4, 1.0, 0), (1, 1, 60, 0.0, 40, 0.0, 50, 0.0, 0), (1, 1, 2, 0.0, 3, 0.0, 9, 0.0, 0), (1, 1, 25, 0.1, 7, 0.0, 12, 0.0, 0),
    (0, 1, 1, 1.0, 1, 1.0, 1, 1.0, 0), (0, 1, 14, 0.0, 30, 0.0, 0, 0.0, 0), (0, 1, 9, 0.0, 1, 1.0, 10, 0.0, 0), (0, 1, 80, 0.0, 20, 0.0, 50, 0.0, 0), (0, 1, 45, 0.0, 70, 0.0, 8, 0.0, 0),
    (0, 0, 90, 0.0, 60, 0.0, 70, 0.0, 1), (0, 0, 35, 0.05, 12, 0.0, 40, 0.0, 1), (0, 0, 20, 0.0, 50, 0.0, 30, 0.0, 1), (0, 0, 6, 0.0, 2, 0.0, 85, 0.0, 1), (0, 0, 12, 0.0, 45, 0.0, 25, 0.0, 1),
    (0, 0, 2, 1.0, 2, 1.0, 2, 1.0, 0), (0, 0, 5, 0.9, 40, 0.0, 3, 1.0, 0), (0, 0, 4, 0.0, 3, 1.0, 2, 1.0, 0), (0, 0, 18, 0.8, 3, 1.0, 9, 0.7, 0), (0, 0, 3, 0.0, 0, 0.0, 2, 1.0, 0),
    (1, 0, 70, 0.0, 90, 0.0, 3, 1.0, 1), (1, 0, 18, 0.1, 60, 0.0, 1, 1.0, 1), (1, 0, 6, 0.0, 40, 0.0, 2, 0.9, 1), (1, 0, 1, 0.0, 2, 1.0, 1, 1.0, 1), (1, 0, 45, 0.0, 3, 1.0, 4, 1.0, 1),
    (0, 0, 60, 0.0, 80, 0.0, 2, 1.0, 1), (0, 0, 25, 0.1, 40, 0.0, 1, 1.0, 1), (0, 0, 110, 0.0, 2, 1.0, 3, 0.9, 1), (0, 0, 14, 0.0, 35, 0.0, 6, 0.8, 1), (0, 0, 40, 0.2, 1, 1.0, 1, 1.0, 1),
    (1, 0, 2, 1.0, 3, 1.0, 2, 1.0, 0), (1, 0, 6, 1.0, 2, 1.0, 5, 0.9, 0), (1, 0, 12, 0.9, 9, 0.9, 14, 1.0, 0), (1, 0, 4, 1.0, 50, 0.0, 3, 1.0, 0), (1, 0, 3, 1.0, 4, 1.0, 0, 0.0, 0),
    (0, 0, 3, 1.0, 60, 0.0, 4, 1.0, 0), (0, 0, 2, 1.0, 3, 1.0, 0, 0.0, 0), (0, 0, 30, 0.9, 25, 0.9, 28, 1.0, 0), (0, 0, 4, 1.0, 2, 1.0, 40, 0.0, 0), (0, 0, 2, 0.0, 70, 0.0, 3, 1.0, 0),
    (0, 0, 2, 0.0, 60, 0.0, 45, 0.0, 1), (0, 0, 1, 0.0, 30, 0.0, 20, 0.0, 1), (0, 0, 4, 0.0, 80, 0.0, 0, 0.0, 1), (1, 0, 4, 1.0, 150, 0.0, 2, 1.0, 0), (0, 0, 3, 1.0, 120, 0.0, 3, 1.0, 0),
    (1, 0, 4, 1.0, 80, 0.0, 3, 1.0, 0), (0, 0, 3, 1.0, 75, 0.0, 3, 1.0, 0), (0, 0, 5, 1.0, 85, 0.0, 0, 0.0, 0), (1, 0, 2, 1.0, 40, 0.0, 60, 0.0, 1), (1, 0, 3, 1.0, 4, 1.0, 40, 0.0, 0),
    (1, 0, 5, 1.0, 140, 0.0, 30, 0.0, 1), (0, 0, 4, 1.0, 70, 0.0, 50, 0.0, 0), (0, 0, 3, 1.0, 120, 0.0, 15, 0.0, 0), (1, 0, 2, 1.0, 3, 1.0, 70, 0.0, 0), (1, 0, 3, 1.0, 9, 0.0, 25, 0.0, 1),
)


class Blocks(HTMLParser):
    """Collects (text, linked characters, in_article, boiler) in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, bool]] = []  # tag, skipped, inside an article, boilerplate
        self.blocks: list[tuple[str, int, bool, bool]] = []
        self.parts: list[str] = []
        self.linked, self.in_link = 0, False

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, _, article, boiler = self.stack[-1] if self.stack else ("", False, False, False)
            self.blocks.append((text, self.linked, article, boiler))
        self.parts, self.linked = [], 0

    def leave(self, tag: str, barriers: frozenset[str] = frozenset()) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return
            if self.stack[i][0] in barriers:
                return

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.in_link = any(k == "href" for k, _ in attrs)
        if tag == "br" or tag == "img":
            self.parts.append(" ")
            return
        named = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
        boiler_name = bool(named) and tag not in ("body", "html", "article", "main") and BOILER.search(named.replace("_", "-")) is not None
        if tag in INLINE and not boiler_name:
            return
        if tag in UNSEEN:
            _, _, article, boiler = self.stack[-1] if self.stack else ("", True, False, False)
            self.stack.append((tag, True, article, boiler))
            return
        self.flush()
        if tag in VOID:
            return
        if tag == "body":
            self.leave("head")
        if tag not in INLINE:
            self.in_link = False
            self.leave("p", frozenset(("td", "th", "li", "div", "section", "article", "main", "body")))
        if tag == "li":
            self.leave("li", frozenset(("ul", "ol", "menu")))
        _, skip, article, boiler = self.stack[-1] if self.stack else ("", False, False, False)
        boiler = boiler or boiler_name or tag in OUTSIDE or tag == "header" and not article
        self.stack.append((tag, skip or tag in SKIP, article or tag in INSIDE, boiler))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "a":
            self.in_link = False
        if tag in INLINE and not any(t[0] == tag for t in self.stack):
            return
        if tag not in UNSEEN:
            self.flush()
        self.leave(tag)

    def handle_data(self, data):
        if not (self.stack and self.stack[-1][1]):
            self.parts.append(data)
            if self.in_link:
                self.linked += len("".join(data.split()))


#: Elements whose inside is no markup, and comments; an unclosed one goes to the end of the page.
_UNREAD = re.compile(r"<(script|style|title|textarea|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[|<\?[^>]*(?:>|\Z)", re.I | re.S)


def blocks_of(html: str | None) -> list[tuple[str, int, bool, bool]]:
    """The blocks of a page.  A tag that the page's end cuts off is dropped with what follows it, so that broken markup is
    read in one pass."""
    page = _UNREAD.sub("", html or "")
    p = Blocks()
    end = page.rfind(">") + 1
    p.feed(page[:end])
    tail = page.find("<", end)
    while tail >= 0 and not re.match(r"[a-zA-Z/!?]", page[tail + 1 : tail + 2]):
        tail = page.find("<", tail + 1)
    rest = page[end:] if tail < 0 else page[end:tail]
    p.feed(rest.replace("<", "&lt;"))
    p.close()
    p.flush()
    return p.blocks


def describe(blocks: list[tuple[str, int, bool, bool]]) -> np.ndarray:
    words = np.array([b[0].count(" ") + 1 for b in blocks], float)
    links = np.array([b[1] / max(1, len(b[0].replace(" ", ""))) for b in blocks], float)
    shift = lambda x, k: np.concatenate([[0.0], x[:-1]]) if k else np.concatenate([x[1:], [0.0]])
    return np.column_stack([[float(b[2]) for b in blocks], [float(b[3]) for b in blocks], words, links, shift(words, 1), shift(links, 1), shift(words, 0), shift(links, 0)])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6):
    """A tree of (feature, threshold, low, high) by Gini impurity; a leaf is 0 or 1."""
    if depth == 0 or len(set(y)) == 1:
        return int(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= t
            score = sum(m.sum() * y[m].mean() * (1 - y[m].mean()) for m in (left, ~left))
            if best is None or score < best[0] - 1e-12:
                best = (score, f, t)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, t = best
    left = x[:, f] <= t
    return f, float(t), grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


def trained():
    table = np.array(LABELLED, float)
    return grow(table[:, :-1], table[:, -1])


def decide(tree, row: np.ndarray) -> int:
    while not isinstance(tree, int):
        f, t, low, high = tree
        tree = low if row[f] <= t else high
    return tree


def main_text(html: str | None, tree) -> str:
    blocks = blocks_of(html)
    if not blocks:
        return ""
    return "\n\n".join(b[0] for b, row in zip(blocks, describe(blocks), strict=True) if decide(tree, row))


def _extract(batches: Iterator[pa.RecordBatch], tree) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h.as_py(), tree) for h in b.column(b.num_columns - 1)]
        out = [*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(out, [str(i) for i in range(len(out))])


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without the html, with text and n_chars."""
    ship(pages.sparkSession)
    tree = trained()
    keep = pages.select([F.col(f"`{c}`") for c in pages.columns if c not in (html, "text", "n_chars")])
    schema = StructType(list(keep.schema.fields)).add("text", "string").add("n_chars", "long")
    rows = pages.select(*[F.col(f"`{c}`") for c in keep.columns], F.col(html).alias("_body"))
    return rows.mapInArrow(lambda it: _extract(it, tree), schema)
