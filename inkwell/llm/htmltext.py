"""HTML extraction (operator 6): composite text density.

A page becomes a tree by a tolerant reading of its tags: void elements have no content, `p`, `li`, `td` and the like end where the
next one begins, stray end tags are ignored, comments, scripts, styles and declarations have no text. Every node has C characters
and T tags in its subtree, LC and LT of them within links. With those of the body, LCb and Cb, its composite density is

    C/T * log(base = ln(C / (C - LC) * LC + LCb / Cb * C + e), (C / LC) * (T / LT))

with counts of 0 under a fraction taken as 1. A node's density sum adds its children's densities. The content is the subtree of
the body whose node has the greatest density sum. The threshold is the least density on the path from the body to that node; block
elements of the subtree that are less dense, such as lists of links, are left out. Each block element begins a line.

Defined results: a NULL or empty page, and one without text in its body, gives an empty text and density 0; of equal sums the node
that comes first, and is outermost, wins; broken markup never fails, and an
svg, template or noscript without its end tag hides nothing; a "<" that begins no tag with an end is text; very deep trees are
walked without recursion, and the time follows the page's length, whatever is open, unended or stray in it; repeated
rows give equal results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Without backtracking, so a failure costs one look ahead; after the first in a page `_Careful` takes over.
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)")
_MARK = re.compile("[>\"']")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title svg".split())
#: Those that reach to the end of a page without their end tag, as in browsers; of the others the tag alone is skipped.
_TO_END = frozenset("script style textarea title".split())
_NO_TEXT = _RAW | {"head"}
_BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: Elements that an opening tag of the key ends, if one is open within the nearest of the second set.
_ENDS = {
    **{t: (frozenset({"p"}), frozenset({"td", "th", "li", "body", "button"})) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()},
    "li": (frozenset({"li"}), frozenset({"ul", "ol"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    parent: int
    parts: list[int | str] = field(default_factory=list)
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    total: float = 0.0


class _Careful:
    """Ends of tags in a page in which some have none: a place from which no end is reached is never looked at twice."""

    def __init__(self, page: str):
        self.page, self.marks, self.bad = page, [m.start() for m in _MARK.finditer(page)], set()
        self.next: dict[str, list[int]] = {q: [k for k in self.marks if page[k] == q] for q in "\"'"}

    def end(self, at: int) -> int:
        """The place of the ">" that ends the tag whose name ends at `at`, or -1."""
        seen = []
        while True:
            k = bisect_left(self.marks, at)
            if k == len(self.marks) or self.marks[k] in self.bad:
                break
            mark = self.marks[k]
            if (quote := self.page[mark]) == ">":
                return mark
            seen.append(mark)
            own = self.next[quote]
            k = bisect_right(own, mark)
            if k == len(own):
                break
            at = own[k] + 1
        self.bad.update(seen)
        return -1


class _Open:
    """Open elements, with the depths of each tag among them."""

    def __init__(self):
        self.ids, self.tags, self.depths = [0], [""], {}

    def push(self, node: int, tag: str) -> None:
        self.depths.setdefault(tag, []).append(len(self.ids))
        self.ids.append(node)
        self.tags.append(tag)

    def last(self, tag: str) -> int:
        """The greatest depth of a tag, 0 if it is not open."""
        own = self.depths.get(tag)
        return own[-1] if own else 0

    def close(self, depth: int) -> None:
        """Ends all elements from this depth on."""
        while len(self.ids) > depth:
            self.ids.pop()
            self.depths[self.tags.pop()].pop()


def parse(page: str | None) -> list[Node]:
    """The nodes in document order; node 0 is the root, and a node comes after its parent."""
    nodes, open_ = [Node("", -1)], _Open()
    page = page or ""
    at, size = 0, len(page)
    careful: _Careful | None = None

    def text(raw: str) -> None:
        if raw and not raw.isspace():
            nodes[open_.ids[-1]].parts.append(html.unescape(raw) if "&" in raw else raw)
        elif raw:
            nodes[open_.ids[-1]].parts.append(" ")

    unended: set[str] = set()
    begin = 0  # of the text before the next tag
    while at < size:
        lt = page.find("<", at)
        if lt < 0 or lt + 1 == size:
            break
        after = page[lt + 1]
        if after in "!?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                end = size if end < 0 else end + 3
            else:
                end = page.find(">", lt) + 1
                if not end:  # no tag ends from here on; only a comment may still begin
                    at = page.find("<!--", lt)
                    if at < 0:
                        break
                    continue
            text(page[begin:lt])
            at = begin = end
            continue
        if careful is None:
            m = _TAG.match(page, lt)
            if m is not None:
                closing, tag, empty, end = m[1], m[2].lower(), m[3].endswith("/"), m.end()
            elif _NAME.match(page, lt):
                careful = _Careful(page)
                continue
            else:
                at = lt + 1
                continue
        else:
            m = _NAME.match(page, lt)
            if m is None or (gt := careful.end(m.end())) < 0:
                at = lt + 1
                continue
            closing, tag, empty, end = m[1], m[2].lower(), page[gt - 1] == "/" and gt > m.end(), gt + 1
        text(page[begin:lt])
        at = begin = end
        if closing:
            if depth := open_.last(tag):
                open_.close(depth)
            continue
        if tag in _ENDS:
            ended, within = _ENDS[tag]
            depth = max(map(open_.last, ended))
            if depth > max(map(open_.last, within)):
                open_.close(depth)
        nodes.append(Node(tag, open_.ids[-1]))
        nodes[open_.ids[-1]].parts.append(len(nodes) - 1)
        if tag in _VOID or empty or tag in unended:
            continue
        if tag in _RAW:
            end_tag = re.compile(f"</{re.escape(tag)}\\s*+>", re.I).search(page, at)
            if end_tag:
                at = begin = end_tag.end()
            elif tag in _TO_END:
                at = begin = size
            else:
                unended.add(tag)
            continue
        open_.push(len(nodes) - 1, tag)
    text(page[begin:])
    return nodes


def measure(nodes: list[Node], body: int) -> None:
    """Counts, densities and density sums of the body's subtree, children before parents."""
    hidden = [False] * len(nodes)
    linked = [False] * len(nodes)
    for k in range(1, len(nodes)):
        p = nodes[k].parent
        hidden[k] = hidden[p] or nodes[k].tag in _NO_TEXT
        linked[k] = linked[p] or nodes[p].tag == "a"
    for k in range(len(nodes) - 1, -1, -1):
        n = nodes[k]
        if not hidden[k]:
            own = sum(len(_SPACE.sub("", x)) for x in n.parts if isinstance(x, str))
            n.chars += own
            if n.tag == "a" or linked[k]:
                n.link_chars += own
        if k:
            up = nodes[n.parent]
            up.chars += n.chars
            up.link_chars += n.link_chars
            if not hidden[k]:
                up.tags += n.tags + 1
                up.link_tags += n.link_tags + (1 if n.tag == "a" or linked[k] else 0)
    b = nodes[body]
    ratio = b.link_chars / max(b.chars, 1)
    for n in nodes:
        n.density = composite_density(n.chars, n.tags, n.link_chars, n.link_tags, ratio)
    for n in nodes:
        n.total = sum(nodes[x].density for x in n.parts if isinstance(x, int))


def composite_density(c: int, t: int, lc: int, lt: int, body_ratio: float) -> float:
    """Density of a node from its characters, tags, and those within links; where no link is anywhere the logarithm is natural."""
    if not c:
        return 0.0
    base = math.log(c / max(c - lc, 1) * lc + body_ratio * c + math.e)
    inside = math.log((c / max(lc, 1)) * (max(t, 1) / max(lt, 1)))
    return c / max(t, 1) * (inside / math.log(base) if math.log(base) > 0 else inside)


def select(nodes: list[Node]) -> tuple[int, float]:
    """The content's top node, -1 of none, and the threshold."""
    body = next((k for k, n in enumerate(nodes) if n.tag == "body"), 0)
    measure(nodes, body)
    if not nodes[body].chars:
        return -1, 0.0
    inside = [False] * len(nodes)
    inside[body] = True
    best = body
    for k in range(body + 1, len(nodes)):
        inside[k] = inside[nodes[k].parent]
        if inside[k] and nodes[k].total > nodes[best].total:
            best = k
    threshold, k = nodes[best].density, best
    while k != body:
        k = nodes[k].parent
        threshold = min(threshold, nodes[k].density)
    return best, threshold


def node_text(nodes: list[Node], top: int, threshold: float = 0.0) -> str:
    """Text of a subtree without its blocks below the threshold: white space collapsed, a line for each block."""
    out: list[str] = []
    todo: list[int | str] = [top]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append("\n" if x == "\0" else _SPACE.sub(" ", x))
            continue
        n = nodes[x]
        if n.tag in _NO_TEXT:
            continue
        if n.tag in _BLOCK:
            if x != top and n.chars and n.density < threshold:
                continue
            out.append("\n")
            todo.append("\0")
        todo += reversed(n.parts)
    lines = (_SPACE.sub(" ", line).strip() for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


def extract(page: str | None) -> tuple[str, str, float]:
    """(text, tag of the selected node, threshold) of a page."""
    nodes = parse(page)
    top, threshold = select(nodes)
    return (node_text(nodes, top, threshold), nodes[top].tag, threshold) if top >= 0 else ("", "", 0.0)


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, tag, threshold) of every page; pages are read where they are, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [extract(x.as_py()) for x in b.column(1)]
            text, tag, threshold = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([b.column(0), pa.array(text, pa.string()), pa.array(tag, pa.string()), pa.array(threshold, pa.float64())], ["page_id", "text", "tag", "threshold"])

    src = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{html_col}`").cast("string").alias("t"))
    return src.mapInArrow(run, f"page_id {pages.schema[id_col].dataType.simpleString()}, text string, tag string, threshold double")
