"""The URL filter over a list of all the block-list-like groups of hosts in pages."""

from __future__ import annotations

from collections import Counter

from inkwell.llm import queries


def test_every_group_is_listed(spark) -> None:
    rows = queries.queries()["op1_url_filter"](spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == 2500
    listed = Counter(next((g for g in ("adult-x", "casino-win", "ads-track", "free-bets", "spam-farm", "cheap-pills") if f"{g}.example." in r.canonical), "") for r in rows if r.listed)
    assert listed == {"adult-x": 15, "casino-win": 31, "ads-track": 26, "free-bets": 26, "spam-farm": 20, "cheap-pills": 18}
