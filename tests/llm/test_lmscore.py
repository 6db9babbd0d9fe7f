from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from inkwell.llm import lmscore as L
from tests.llm.helpers import AWKWARD, LONG, clashing, docs


def plain_scores(texts: list[str | None]) -> list[tuple[int, float]]:
    """Recursive interpolation over dictionaries."""
    n, d = L.ORDER, L.DISCOUNT
    seqs = [bytes([L.START] * (n - 1)) + (t or "").encode() + bytes([L.END]) for t in texts]
    counts = [Counter(s[i - k + 1 : i + 1] for s in seqs for i in range(n - 1, len(s))) for k in range(1, n + 1)]
    ctx = [Counter() for _ in counts]
    left = [Counter() for _ in counts]
    for k, c in enumerate(counts):
        for g, m in c.items():
            ctx[k][g[:-1]] += m
            if m >= L.CUTOFFS[k]:
                left[k][g[:-1]] += m - d

    def p(g: bytes) -> float:
        k = len(g) - 1
        lower = p(g[1:]) if k else 1 / 256
        if not left[k].get(g[:-1]):
            return lower
        own = counts[k][g]
        return max(own - d, 0) / ctx[k][g[:-1]] * (own >= L.CUTOFFS[k]) + (1 - left[k][g[:-1]] / ctx[k][g[:-1]]) * lower

    return [(len(s) - n + 1, sum(math.log(p(s[i - n + 1 : i + 1])) for i in range(n - 1, len(s)))) for s in seqs]


@pytest.mark.parametrize("part_runs", [L.PART_RUNS, 150])
def test_equals_plain_recursion(spark, part_runs: int) -> None:
    rng = random.Random(2)
    rows = [(100 + i, "".join(rng.choices("abcé \n", k=rng.choice([0, 1, 5, 300, 700])))) for i in range(40)]
    rows += [r for r in AWKWARD if r[0] != 8] + [(300, LONG[:3000])]
    got = {r.doc_id: r for r in L.score_documents(clashing(docs(spark, rows)), part_runs=part_runs).collect()}
    assert len(got) == len(rows)
    for (i, _), (n, logp) in zip(rows, plain_scores([t for _, t in rows])):
        assert got[i].n_symbols == n and abs(got[i].logprob - logp) < 1e-3
        assert abs(got[i].bits_per_symbol + logp / math.log(2) / n) < 1e-5


def test_empty_and_repeated(spark) -> None:
    assert L.score_documents(docs(spark, [])).isEmpty()
    got = L.score_documents(docs(spark, [(1, None), (2, ""), (3, "ab"), (3, "ab")])).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_symbols, r.logprob))
    assert by[1] == by[2] and by[1][0][0] == 1 and len(by[3]) == 2 and by[3][0] == by[3][1]


def test_counts_cover_all_documents(spark) -> None:
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("xyz", k=rng.randint(0, 50)))) for i in range(300)]
    src = docs(spark, rows).selectExpr("doc_id", "text as t").repartition(7)
    total = L.count_runs(src).groupBy().sum("c").first()[0]
    assert total == sum(len(t) + 1 for _, t in rows)
