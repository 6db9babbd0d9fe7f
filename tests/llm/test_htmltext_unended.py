"""Raw elements without their end tags."""

from __future__ import annotations

import pytest

from inkwell.llm import htmltext as H

TEXT = "A sentence of plain words that stands in the page, and another one after it."


@pytest.mark.parametrize("tag", ["svg", "template", "noscript"])
def test_the_rest_of_the_page_stays(tag: str) -> None:
    page = f"<html><body><div>first: {TEXT}<{tag} class=x> second: {TEXT}<{tag}> third: {TEXT}</div></body></html>"
    assert H.extract(page)[0] == f"first: {TEXT} second: {TEXT} third: {TEXT}"
    assert H.extract(page) == H.extract(page.replace("> second", f"></{tag}> second").replace("> third", f"></{tag}> third"))


@pytest.mark.parametrize("tag", ["script", "style", "textarea", "title"])
def test_as_in_browsers_others_reach_to_the_end(tag: str) -> None:
    assert H.extract(f"<body><p>{TEXT}</p><{tag}><p>more</p></body>")[0] == TEXT
