"""An id whose one text is a copy still has its other texts compared."""

from __future__ import annotations

from inkwell.llm import neardup as N
from tests.llm.helpers import docs


def test_other_texts_of_an_id_are_compared(spark) -> None:
    a, b = " ".join(f"a{k}" for k in range(60)), [f"b{k}" for k in range(60)]
    near = " ".join(["other", *b[1:]])
    rows = [(1, a), (2, a), (2, " ".join(b)), (3, near), (4, "words of its own that no other text has")]
    assert {tuple(r) for r in N.near_duplicates(docs(spark, rows)).collect()} == {(2, 1), (3, 1)}
