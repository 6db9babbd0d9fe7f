from __future__ import annotations

import math
import random

import pytest

from inkwell.llm import htmltext as H
from tests.llm.helpers import LONG

PAGE = """<!DOCTYPE html><html><head><title>No & title</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">About us</a></ul></nav><!-- <p>ad</p> -->
<div class=ad>Buy now</div><article><h1>A heading &amp; more</h1><p>First <b>bold</b> paragraph with quite a lot of text, so that it is dense.
<p>Second paragraph<br>after a break, also with a good deal of text &lt;here&gt;.</p>
<ul class=rel><li><a href=x>related one</a></li><li><a href=y>related two</a></li></ul></article>
<footer><a href="/c">Contact</a> <a href="/d">Imprint</a></footer></body></html>"""


def tree(nodes: list[H.Node], k: int) -> tuple:
    return (nodes[k].tag, *[tree(nodes, x) if isinstance(x, int) else x.strip() for x in nodes[k].parts if isinstance(x, int) or x.strip()])


def test_tree() -> None:
    got = tree(H.parse("<div>a<p>b<p>c<i>d<div>e</div></i></div>f</nope><br/>g<li>h<ul><li>i</ul>"), 0)
    assert got == ("", ("div", "a", ("p", "b"), ("p", "c", ("i", "d")), ("div", "e")), "f", ("br",), "g", ("li", "h", ("ul", ("li", "i"))))
    assert tree(H.parse("a < b && c > d <3 &lt;x&gt;"), 0) == ("", "a < b && c > d <3 <x>")
    assert tree(H.parse("<td>1<td>2<tr><td>3"), 0)[0] == ""
    assert tree(H.parse('<a title="x > y">z</a><script>if (a<b) "</p>"</script>w'), 0) == ("", ("a", "z"), ("script",), "w")
    assert tree(H.parse("<!-- open <p>x"), 0) == ("",) and tree(H.parse(None), 0) == ("",)


def measured(nodes: list[H.Node], k: int, hidden: bool = False, linked: bool = False) -> dict[int, tuple[int, int, int, int]]:
    """Counts by plain recursion."""
    n = nodes[k]
    hidden = hidden or n.tag in H._NO_TEXT
    linked = linked or n.tag == "a"
    own = 0 if hidden else sum(len("".join(x.split())) for x in n.parts if isinstance(x, str))
    out, c, t, lc, lt = {}, own, 0, own if linked else 0, 0
    for x in n.parts:
        if isinstance(x, int):
            out |= measured(nodes, x, hidden, linked)
            a, b, d, e = out[x]
            c, lc = c + a, lc + d
            if not (hidden or nodes[x].tag in H._NO_TEXT):
                t, lt = t + b + 1, lt + e + (1 if linked or nodes[x].tag == "a" else 0)
            elif not hidden:
                pass
    out[k] = (c, t, lc, lt)
    return out


def random_page(rng: random.Random) -> str:
    def node(depth: int) -> str:
        tag = rng.choice(["div", "p", "a", "ul", "li", "b", "section", "span"])
        inner = "".join(node(depth - 1) if depth and rng.random() < 0.6 else "word " * rng.randint(0, 12) for _ in range(rng.randint(0, 4)))
        return f"<{tag}>{inner}</{tag}>" if rng.random() < 0.9 else f"<{tag}>{inner}"

    return f"<html><body>{''.join(node(4) for _ in range(4))}</body></html>"


@pytest.mark.parametrize("seed", range(20))
def test_counts_sums_and_choice(seed: int) -> None:
    nodes = H.parse(random_page(random.Random(seed)))
    top, threshold = H.select(nodes)
    body = next(k for k, n in enumerate(nodes) if n.tag == "body")
    counts = measured(nodes, 0)
    assert {k: (n.chars, n.tags, n.link_chars, n.link_tags) for k, n in enumerate(nodes)} == counts
    c, _, lc, _ = counts[body]
    if not c:
        assert top == -1
        return

    def density(k: int) -> float:
        n, t, a, b = counts[k]
        if not n:
            return 0.0
        base = math.log(math.log(n / max(n - a, 1) * a + lc / max(c, 1) * n + math.e))
        x = math.log(n / max(a, 1) * max(t, 1) / max(b, 1))
        return n / max(t, 1) * (x / base if base > 0 else x)

    sums = {k: sum(density(x) for x in n.parts if isinstance(x, int)) for k, n in enumerate(nodes)}
    inside = [k for k in range(len(nodes)) if k == body or body in list(path(nodes, k))]
    assert sums[top] == pytest.approx(max(sums[k] for k in inside)) and top == min(k for k in inside if sums[k] == sums[top])
    assert threshold == pytest.approx(min(density(k) for k in [top, *[k for k in path(nodes, top) if k == body or body in list(path(nodes, k))]]))


def path(nodes: list[H.Node], k: int):
    while nodes[k].parent >= 0:
        k = nodes[k].parent
        yield k


def test_article_is_found() -> None:
    text, tag, threshold = H.extract(PAGE)
    assert tag == "article" and threshold > 0
    assert text == "A heading & more\nFirst bold paragraph with quite a lot of text, so that it is dense.\nSecond paragraph\nafter a break, also with a good deal of text <here>."


def test_awkward_pages(spark) -> None:
    deep = "<div>" * 20_000 + "deep text" + "</div>" * 100
    rows = [(1, None), (2, ""), (3, "no tags at all"), (4, "<html><body></body></html>"), (5, f"<p>{LONG}"), (6, deep), (7, "<<<>>> </ <a"), (8, PAGE), (8, PAGE), (None, PAGE), (9, "<body><script>x</script></body>")]
    df = spark.createDataFrame([(i, h, 1, "x") for i, h in rows], "page_id long, html string, t int, text string")
    got = {}
    for r in H.extract_pages(df).collect():
        got.setdefault(r.page_id, []).append((r.text, r.tag, r.threshold))
    assert got[1] == got[2] == got[4] == got[9] == [("", "", 0.0)]
    assert got[3][0][0] == "no tags at all" and got[5][0][0] == LONG and "deep text" in got[6][0][0]
    assert got[8] == [H.extract(PAGE)] * 2 and got[None] == got[8][:1] and len(got[7]) == 1
    assert H.extract_pages(df.limit(0)).isEmpty()
