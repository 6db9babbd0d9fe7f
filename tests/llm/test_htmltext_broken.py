"""Long broken pages take time in proportion to their length, and are read as short ones are."""

from __future__ import annotations

import random
import re
import time

import pytest

from inkwell.llm import htmltext as H

MB = 1 << 20
BROKEN = {
    "unended tags": "<a " * (MB // 3),
    "unended quotes": '<p title="a ' * (MB // 12),
    "unended quotes and an end": '<p title="a ' * (MB // 12) + "'>",
    "mixed quotes": "<p a='x\" " * (MB // 9),
    "unended declarations": "<!x " * (MB // 4),
    "stray end tags": "<div>" * 100_000 + "</x>" * 100_000,
    "nested blocks": "<div>" * 200_000 + "text",
    "nested spans": "<span>" * 100_000 + "<p>x" * 100_000,
    "unended svg": "<svg>" * 200_000,
    "blanks in an end tag": "<script>" + ("</script" + " " * 40) * 20_000,
    "open angles": "< " * (MB // 2),
}


@pytest.mark.parametrize("kind", BROKEN)
def test_time_follows_the_length(kind: str) -> None:
    start = time.perf_counter()
    H.extract(BROKEN[kind])
    assert time.perf_counter() - start < 20


_SLOW = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)


def tokens(page: str) -> list[str]:
    """Names of tags, and text, by one plain expression."""
    out, at = [], 0
    for m in _SLOW.finditer(page):
        out += [page[at : m.start()], m[2].lower() if m[2] else ""]
        at = m.end()
    return [x for x in [*out, page[at:]] if x]


def test_tags_are_those_of_a_plain_expression() -> None:
    rng = random.Random(5)
    parts = ["<i ", "<i>", "</i>", ">", '"', "'", "x", " a=", "<!", "<!--", "-->", "<?", "<", "/>", "<b", "</", "&lt;"]
    for _ in range(3000):
        page = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        nodes = H.parse(page)
        want = tokens(page)
        got = "".join(x if isinstance(x, str) else "" for n in nodes for x in n.parts)
        tags = [n.tag for n in nodes[1:]]
        opened = [m[2].lower() for m in _SLOW.finditer(page) if m[2] and not m[1]]
        assert tags == opened, page
        plain = H.html.unescape("".join(page[a:b] for a, b in zip([0, *[m.end() for m in _SLOW.finditer(page)]], [*[m.start() for m in _SLOW.finditer(page)], len(page)])))
        assert sorted(got.replace(" ", "")) == sorted(plain.replace(" ", "")), (page, want)
