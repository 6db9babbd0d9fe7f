"""The registered queries against their SQL, and what they promise about planted cases."""

from __future__ import annotations

import pytest

import __spark_entry__
from inkwell.llm import queries
from tests.test_queries import compare

SF = "/root/testdata/sf0.001"


def test_one_query_an_operator() -> None:
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name: str) -> None:
    compare(spark, name, queries.queries()[name], queries.oracle_sql()[name], SF)
