from __future__ import annotations

import random

import numpy as np
import pytest

from inkwell.llm import decontaminate as D
from tests.llm.helpers import AWKWARD, LONG, clashing, docs, words


def plain_spans(text: str | None, items: list[str | None], n: int = D.N_WORDS) -> list[tuple[int, int, int]]:
    phrases = {tuple(w[i : i + n]) for t in items if (w := words(t)) for i in range(max(1, len(w) - n + 1))}
    w, hits = words(text), []
    for i in range(len(w)):
        hits += [(i, i + m) for m in {len(p) for p in phrases} if tuple(w[i : i + m]) in phrases and i + m <= len(w)]
    out: list[list[int]] = []
    for s, e in sorted(hits):
        if out and s <= out[-1][1]:
            out[-1][1:] = [max(out[-1][1], e), out[-1][2] + 1]
        else:
            out.append([s, e, 1])
    return [tuple(x) for x in out]


def test_suffix_array_index_and_locate() -> None:
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, sigma = int(rng.integers(1, 80)), int(rng.integers(2, 6))
        t = np.append(rng.integers(1, sigma, n), 0)
        assert D.suffix_array(t, sigma).tolist() == sorted(range(n + 1), key=lambda i: t[i:].tolist())
        ix = D.FMIndex(t, sigma, 4)
        m = int(rng.integers(1, 6))
        p = rng.integers(1, sigma, (4, 5))
        lo, hi = ix.search(p, np.full(4, m))
        for k in range(4):
            assert sorted(ix.locate(np.arange(lo[k], hi[k])).tolist()) == [i for i in range(n + 1) if t[i : i + m].tolist() == p[k, :m].tolist()]
        c = rng.integers(0, sigma, 7)
        at = rng.integers(0, n + 2, 7)
        bwt = ix.bwt.access(np.arange(n + 1))
        assert ix.bwt.rank(c, at)[0].tolist() == [int((bwt[:i] == x).sum()) for x, i in zip(c, at)]


ITEMS = ["Alpha beta gamma delta epsilon zeta eta theta iota kappa", "short item here", None, "", "??", "Alpha beta gamma delta epsilon zeta eta theta iota kappa", "r " * 30]


def corpus() -> list[tuple[int | None, str | None]]:
    rng = random.Random(1)
    pool = words(ITEMS[0]) + words(ITEMS[1]) + ["r", "foo", "bar"]
    rows: list[tuple[int | None, str | None]] = [(100 + i, " ".join(rng.choices(pool, k=rng.randint(0, 40)))) for i in range(60)]
    rows += [(200, f"Überschrift — ALPHA, beta; gamma: delta\nepsilon zeta eta theta! then {ITEMS[1].upper()}... end"), (201, ITEMS[0]), (202, "r " * 100), (203, LONG + " " + ITEMS[0] + " " + LONG)]
    return rows + AWKWARD


@pytest.mark.parametrize(("shard", "group"), [(D.SHARD_BYTES, D.GROUP), (300, D.GROUP), (D.SHARD_BYTES, 7)])
def test_equals_plain_search(spark, shard: int, group: int) -> None:
    rows = corpus()
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(ITEMS)], "item_id long, text string")
    got = D.find_spans(clashing(docs(spark, rows)), bench, shard_bytes=shard, group=group).collect()
    want = {(i, *s) for i, t in rows for s in plain_spans(t, ITEMS)}
    assert {(r.doc_id, r.start_word, r.end_word, r.n_phrases) for r in got} == want and len(got) == len(want)
    text = dict(rows)
    for r in got:
        assert words(text[r.doc_id][r.char_start : r.char_end]) == words(text[r.doc_id])[r.start_word : r.end_word]


def test_removal(spark) -> None:
    rows = corpus()
    df = clashing(docs(spark, rows))
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(ITEMS)], "item_id long, text string")
    left = D.remove_spans(df, D.find_spans(df, bench))
    assert left.columns == df.columns
    out = [(r.doc_id, r.text) for r in left.collect()]
    want = []
    for i, t in rows:
        spans = plain_spans(t, ITEMS)
        w = words(t)
        kept = [x for k, x in enumerate(w) if not any(s <= k < e for s, e, _ in spans)]
        if not spans or kept:
            want.append((i, kept))
    assert sorted(((i, words(t)) for i, t in out), key=str) == sorted(want, key=str)
    assert ([t for i, t in out if i == 200]) == ["Überschrift — ! then ... end"]
    assert 201 not in {i for i, _ in out}


def test_empty_tables(spark) -> None:
    bench = spark.createDataFrame([(1, ITEMS[0])], "item_id long, text string")
    assert D.find_spans(docs(spark, []), bench).isEmpty()
    assert D.find_spans(docs(spark, [(1, ITEMS[0])]), bench.limit(0)).isEmpty()
    assert D.remove_spans(docs(spark, []), D.find_spans(docs(spark, []), bench)).isEmpty()
