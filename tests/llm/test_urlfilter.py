from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import urlfilter as U

FORMS = {
    "https://www.Example.com/a/b/?utm_source=feed#top": "example.com/a/b",
    "http://m.example.com:80/a?b=2&a=1&ref=x": "example.com/a?a=1&b=2",
    "example.com": "example.com",
    "HTTPS://user:pw@EXAMPLE.com:443/A.html": "example.com/A.html",
    "http://example.com:8080/": "example.com:8080",
    "http://example.com?x=1": "example.com?x=1",
    "http://example.com/a?ref=x#y?z=1": "example.com/a",
    "  http://example.com/ä  ": "example.com/ä",
    "": None,
    "   ": None,
    None: None,
    "http://mm.example.com/reference?reference=1": "mm.example.com/reference?reference=1",
}


def test_canonical_forms(spark) -> None:
    rows = spark.createDataFrame([(u,) for u in FORMS], "u string").select("u", U.canonical(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in rows} == FORMS


@pytest.mark.parametrize("most", [U.MOST_BLOCKS, 1])
@pytest.mark.parametrize("bits", [U.BITS_PER_URL, 1])
def test_exact_for_any_filter_size(spark, most: int, bits: int) -> None:
    rng = random.Random(bits)
    urls = [rng.choice(["http://", "https://www.", "https://m."]) + f"h{rng.randrange(40)}.org/p{rng.randrange(40)}" + rng.choice(["", "/", "#x", "?utm_a=1"]) for _ in range(900)]
    pages = spark.createDataFrame([(i, u, 1, 2, True, "k") for i, u in enumerate(urls)] + [(1000, None, 1, 2, True, "k"), (1001, "", 1, 2, True, "k"), (1002, "http://h0.org/p0" + "x" * 300_000, 1, 2, True, "k")], "page_id long, url string, h long, canonical long, listed boolean, block string")
    listed = spark.createDataFrame([(f"h{k}.org/p{j}",) for k in range(0, 40, 3) for j in range(0, 40, 2)] + [("h0.org/p0",), (None,), ("",)], "url string")
    got = U.filter_urls(pages, listed, most_blocks=most, bits_per_url=bits).collect()
    assert len(got) == 903
    for r in got:
        if r.page_id == 1002:
            assert len(r.canonical) == 300_009 and not r.listed
        elif r.url:
            host, path = r.canonical.split("/")
            assert r.listed == (int(host[1:-4]) % 3 == 0 and int(path[1:]) % 2 == 0)
        else:
            assert r.canonical is None and not r.listed


def test_filter_has_no_false_negatives_and_few_false_positives(spark) -> None:
    h = np.random.default_rng(0).integers(-(1 << 63), 1 << 63, 20_000)
    blocks = 10_000 * U.BITS_PER_URL // 512
    table = np.zeros((blocks, 8), np.uint64)
    t = U.build_filter(spark.createDataFrame([(int(x),) for x in h[:10_000]], "h long"), blocks).toArrow()
    for i in range(8):
        table[t["block"].to_numpy(), i] = t[f"w{i}"].to_numpy().view(np.uint64)
    assert U.may_contain(table, h[:10_000]).all()
    assert U.may_contain(table, h[10_000:]).mean() < 0.02


def test_empty(spark) -> None:
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert [r.listed for r in U.filter_urls(pages, pages.limit(0)).collect()] == [False]
    assert U.filter_urls(pages.limit(0), pages).isEmpty()
    assert [r.listed for r in U.filter_urls(pages, pages).collect()] == [True]


def test_misses_are_not_moved(spark) -> None:
    """The shuffle of the exact join is over possible hits; the other branch has none."""
    pages = spark.createDataFrame([(i, f"http://a{i}.org/") for i in range(300)], "page_id long, url string")
    listed = spark.createDataFrame([(f"http://a{i}.org",) for i in range(0, 300, 30)], "url string")
    with_no_broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = U.filter_urls(pages, listed)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.page_id for r in df.where("listed").collect()) == list(range(0, 300, 30))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_no_broadcast)
    union = plan.index("Union")
    join = plan.index("SortMergeJoin")
    assert "Exchange" not in plan[union:join]
