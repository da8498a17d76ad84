"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks at block-level tags. A linear classifier over a block's text, links and the elements that hold
it gives the cost of calling it content or boilerplate; the costs are the capacities to the two terminals. Neighbours in
page order, and blocks that share a parent element, are joined by smoothness edges whose weight falls with their distance
in the element tree. The minimum cut, by Dinic's maximum flow, is the labelling of least total cost: a short
paragraph inside an article goes with its neighbours, a long advert between menus does not make them content.

Every page is read whole, by itself; there is no shuffle. Tags are found by one linear scan that takes broken markup as it
comes: an unclosed element ends with its parent, an unfinished tag at the end of a page is dropped.

Defined results: a null or empty html gives an empty text; a page without content blocks too; repeated rows give
repeated rows; character references are decoded once, in text alone; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.llm.common import prepare, text_of

SCHEMA = "page_id long, url string, text string, n_chars long"

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p"
    " pre section select summary table tbody td template textarea tfoot th thead tr ul".split()
)
#: Elements whose content is never text of the page.
RAW_TAGS = frozenset("script style template textarea title svg math iframe object noframes noembed".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold boilerplate by their meaning.
OUTER_TAGS = frozenset("aside button dialog fieldset footer form head legend menu nav noscript option select".split())
INNER_TAGS = frozenset("article main".split())
#: Words in class, id or role that tell what an element holds.
OUTER_WORDS = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus"
    " footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted"
    " recommended related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe"
    " subscription tags toolbar topbar widget widgets".split()
)
#: In one name with a word of QUALIFIERS these tell nothing: "post-header", "has-sidebar".
LAYOUT_WORDS = frozenset("footer header login menu nav search sidebar tags toolbar".split())
QUALIFIERS = frozenset("article content entry has layout main no page post story with without wrapper".split())
INNER_WORDS = frozenset("article body content entry main post prose story text".split())

#: The classifier: weights of a block's evidence in favour of content.
BIAS = -1.0
OUTER_WEIGHT, INNER_WEIGHT, WORD_WEIGHT, HIDDEN_WEIGHT = -9.0, 3.0, 1.0, -9.0
LENGTH_WEIGHT, LENGTH_UNIT, LENGTH_MOST = 1.0, 80, 4.0
SENTENCE_WEIGHT, HEADING_WEIGHT, PARAGRAPH_WEIGHT, LINK_WEIGHT = 0.7, 0.6, 0.8, -5.0
#: Smoothness of neighbours; halved for each step between their parents in the element tree.
NEXT_WEIGHT, PARENT_WEIGHT = 1.2, 0.6

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[!?/][^>]*+(?:>|\Z)|/?[a-zA-Z][^>]*+\Z)""", re.S)
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[a-z]+")
_CLOSERS = {tag: re.compile(rf"</{tag}\b[^>]*+>?", re.I) for tag in RAW_TAGS}
_SENTENCE = re.compile(r"[.!?:;…。！？]")


@dataclass(slots=True)
class Element:
    tag: str
    parent: Element | None
    depth: int
    outer: bool
    inner: bool
    worded: bool
    hidden: bool


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    tag: str
    element: Element
    edges: list[tuple[int, float]] = field(default_factory=list)


def element(tag: str, attributes: str, parent: Element | None) -> Element:
    outer, inner, worded, hidden = (parent.outer, parent.inner, parent.worded, parent.hidden) if parent else (False, False, False, False)
    if tag in INNER_TAGS:
        inner = True
    if tag in OUTER_TAGS or (tag == "header" and not inner):
        outer = True
    if attributes:
        if tag not in ("html", "body"):
            for m in _HINT.finditer(attributes):
                for name in m[1].strip("\"'").lower().split():
                    words = set(_WORD.findall(name))
                    if words & QUALIFIERS:
                        words -= LAYOUT_WORDS
                    if words & OUTER_WORDS and tag not in INNER_TAGS:
                        outer = True
                    elif words & INNER_WORDS:
                        worded = True
        if _HIDDEN.search(attributes):
            hidden = True
    return Element(tag, parent, parent.depth + 1 if parent else 0, outer, inner, worded, hidden)


def blocks_of(html: str) -> list[Block]:
    """The page's blocks of text in order."""
    out: list[Block] = []
    here = element("", "", None)
    parts: list[str] = []
    linked, link_depth = 0, 0
    at, n = 0, len(html)

    def flush() -> None:
        nonlocal linked, link_depth
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, linked, here.tag, here))
        parts.clear()
        linked = link_depth = 0

    while at < n:
        lt = html.find("<", at)
        m = _TAG.match(html, lt) if lt >= 0 else None
        end = n if lt < 0 else lt if m else lt + 1
        if end > at:
            piece = html[at:end]
            if "&" in piece:
                piece = unescape(piece)
            parts.append(piece)
            if link_depth:
                linked += len(piece)
        if m is None:
            at = end
            continue
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        closing, attributes = (m[1], m[3]) if m[2] else (m[4], m[6])
        if tag in RAW_TAGS:
            if not closing and not attributes.endswith("/"):
                stop = _CLOSERS[tag].search(html, at)
                at = stop.end() if stop else n
                if tag in BLOCK_TAGS:
                    flush()
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            link_depth = 0 if closing else 1
        elif tag in BLOCK_TAGS:
            flush()
            if closing:
                up = here
                while up.parent is not None and up.tag != tag:
                    up = up.parent
                if up.parent is not None:
                    here = up.parent
            elif tag not in VOID_TAGS:
                if here.tag == "p" or (here.tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                    here = here.parent
                here = element(tag, attributes, here)
    flush()
    return out


def evidence(b: Block) -> float:
    """The classifier's weight in favour of content."""
    e, n = b.element, len(b.text)
    score = BIAS + LENGTH_WEIGHT * min(n / LENGTH_UNIT, LENGTH_MOST) + LINK_WEIGHT * min(1.0, b.linked / n)
    score += SENTENCE_WEIGHT * bool(_SENTENCE.search(b.text))
    score += PARAGRAPH_WEIGHT * (b.tag in ("p", "pre", "blockquote")) + HEADING_WEIGHT * (b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"))
    score += INNER_WEIGHT * e.inner + WORD_WEIGHT * e.worded
    return score + OUTER_WEIGHT * e.outer + HIDDEN_WEIGHT * e.hidden


def tree_steps(a: Element, b: Element, most: int = 12) -> int:
    """Steps between two elements in the element tree, most at the most."""
    steps = 0
    while a is not b and steps < most:
        if a.depth >= b.depth and a.parent is not None:
            a = a.parent
        elif b.parent is not None:
            b = b.parent
        else:
            break
        steps += 1
    return steps


def join_neighbours(blocks: list[Block]) -> None:
    """Edges between neighbours in order, and between successive blocks of one parent element."""
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            steps = tree_steps(blocks[i - 1].element, b.element)
            # what an element's meaning sets apart is not drawn together
            apart = blocks[i - 1].element.outer != b.element.outer
            b.edges.append((i - 1, NEXT_WEIGHT * 0.5**steps * (0.25 if apart else 1.0)))
        parent = b.element.parent
        if parent is not None:
            before = last.get(id(parent))
            if before is not None:
                b.edges.append((before, PARENT_WEIGHT))
            last[id(parent)] = i


class Flow:
    """Maximum flow by Dinic's level graphs."""

    def __init__(self, nodes: int) -> None:
        self.to: list[int] = []
        self.room: list[float] = []
        self.at: list[list[int]] = [[] for _ in range(nodes)]

    def edge(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        for x, y, room in ((a, b, there), (b, a, back)):
            self.at[x].append(len(self.to))
            self.to.append(y)
            self.room.append(room)

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.at)
        level[source] = 0
        queue = deque((source,))
        while queue:
            x = queue.popleft()
            for e in self.at[x]:
                if self.room[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level

    def run(self, source: int, sink: int) -> list[int]:
        """Saturate; the levels that are left: nodes at -1 are on the sink's side."""
        while True:
            level = self.levels(source)
            if level[sink] < 0:
                return level
            nxt = [0] * len(self.at)
            path: list[int] = []
            x = source
            while True:
                if x == sink:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    cut = next(i for i, e in enumerate(path) if self.room[e] <= 1e-9)
                    x = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                edges = self.at[x]
                while nxt[x] < len(edges):
                    e = edges[nxt[x]]
                    if self.room[e] > 1e-9 and level[self.to[e]] == level[x] + 1:
                        break
                    nxt[x] += 1
                else:
                    if x == source:
                        break
                    e = path.pop()
                    x = self.to[e ^ 1]
                    nxt[x] += 1
                    continue
                path.append(e)
                x = self.to[e]


def content(blocks: list[Block]) -> list[bool]:
    """The labelling of least cost."""
    join_neighbours(blocks)
    source, sink = len(blocks), len(blocks) + 1
    flow = Flow(len(blocks) + 2)
    for i, b in enumerate(blocks):
        score = evidence(b)
        if score > 0:
            flow.edge(source, i, score)
        else:
            flow.edge(i, sink, -score)
        for j, weight in b.edges:
            flow.edge(i, j, weight, weight)
    level = flow.run(source, sink)
    return [level[i] >= 0 for i in range(len(blocks))]


def main_text(html: str) -> str:
    blocks = blocks_of(html)
    return "\n\n".join(b.text for b, keep in zip(blocks, content(blocks), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), text_of("html").alias("html")).mapInArrow(run, SCHEMA)
