from __future__ import annotations

import random

import pytest

from inkwell.llm import linededup as L
from tests.llm.helpers import AWKWARD, clashing, docs, words


def brute(rows, min_chars: int = L.MIN_CHARS) -> list[tuple[int | None, str | None]]:
    """Keeps each line's first place by (id, line number), NULL ids first."""
    first: dict[str, tuple] = {}
    for i, t in rows:
        for no, line in enumerate((t or "").split("\n") if t is not None else []):
            key, at = line.strip(" "), ((i is not None, i), no)
            if len(key) >= min_chars:
                first[key] = min(first.get(key, at), at)
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, t))
            continue
        lines = t.split("\n")
        kept = [x for no, x in enumerate(lines) if len(x.strip(" ")) < min_chars or first[x.strip(" ")] == ((i is not None, i), no)]
        if len(kept) == len(lines):
            out.append((i, t))
        elif words("\n".join(kept)):
            out.append((i, "\n".join(kept)))
    return out


def corpus(seed: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    lines = [f"this is line number {k} of the pool" for k in range(40)] + ["short", "", "   ", "}"]
    return [(rng.randrange(-50, 500) * 7 + k % 3, "\n".join(rng.choice(["", " "]) + x for x in rng.choices(lines, k=rng.randint(0, 12)))) for k in range(120)]


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (6, 3), (7, 2)])
def test_equals_brute_force(spark, batches: int, fanout: int) -> None:
    rows = list(dict(corpus(batches)).items()) + AWKWARD
    df = clashing(docs(spark, rows))
    got = L.dedup_lines(df, batches=batches, fanout=fanout)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(brute(rows), key=str)


def test_counts_and_empty(spark) -> None:
    line = "one rather long line of text here"
    r = L.dedup_lines(docs(spark, [(1, f"{line}\nx\n{line}"), (2, f"{line}\ny"), (3, line)]), count_as="gone").orderBy("doc_id").collect()
    assert [(x.doc_id, x.text, x.gone) for x in r] == [(1, f"{line}\nx", 1), (2, "y", 1)]
    assert L.dedup_lines(docs(spark, [])).isEmpty()


def test_runs_are_compacted(spark, tmp_path) -> None:
    runs = L.LineRuns(spark, f"file://{tmp_path}", buckets=2, fanout=3)
    seen: set[int] = set()
    rng = random.Random(0)
    for b in range(9):
        own = sorted({rng.randrange(60) for _ in range(15)})
        new = spark.createDataFrame([(h, h * 2, b, 0) for h in own], "h1 long, h2 long, doc_id long, no int")
        name = runs.add(new)
        if spark.catalog.tableExists(name):
            assert {r.h1 for r in spark.table(name).collect()} == set(own) - seen
        seen |= set(own)
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    rows = runs.all().collect()
    assert {r.h1 for r in rows} == seen and len(rows) == len(seen)
    plan = spark.table(runs.levels[2][0]).alias("a").join(spark.table(runs.levels[2][0]).alias("b").hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    runs.close()
