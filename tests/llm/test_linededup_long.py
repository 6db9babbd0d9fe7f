"""Documents of many lines, and stores that several batches and sessions use."""

from __future__ import annotations

import time

from inkwell.llm import linededup as L
from tests.llm.helpers import AWKWARD, clashing, docs


def test_time_follows_the_lines(spark) -> None:
    n = 200_000
    lines = [f"this is line number {k} of a long document" for k in range(n)]
    df = docs(spark, [(1, "\n".join(lines)), (2, "\n".join(lines)), (3, "\n".join([*lines, "its own last line"]))])
    start = time.perf_counter()
    got = {r.doc_id: (len(r.text.split("\n")), r.gone) for r in L.dedup_lines(df, count_as="gone").collect()}
    assert got == {1: (n, 0), 3: (1, n)}
    assert time.perf_counter() - start < 60


def test_rows_of_one_id_lose_only_their_own_lines(spark) -> None:
    rows = [(1, "a line that stands first\nanother line"), (2, "a line that stands first\nsomething else"), (2, "what only this row has\nanother line\nshort")]
    got = sorted((r.doc_id, r.text) for r in L.dedup_lines(docs(spark, rows)).collect())
    assert got == [(1, "a line that stands first\nanother line"), (2, "something else"), (2, "what only this row has\nshort")]


def test_batches_meet_in_a_durable_store(spark, tmp_path) -> None:
    at = f"file://{tmp_path}/store"
    first = [(5, "alpha line\nbeta line"), (6, "alpha line\ngamma line")]
    runs = L.LineRuns.open(spark, at, buckets=2)
    out = sorted((r.doc_id, r.text) for r in L.dedup_batch(docs(spark, first), runs).collect())
    assert out == [(5, "alpha line\nbeta line"), (6, "gamma line")]
    runs.close()
    # the same folder in another session: earlier batches keep their lines whatever the ids
    runs = L.LineRuns.open(spark, at)
    assert runs.buckets == 2 and len(runs._names()) == 1
    out = sorted((r.doc_id, r.text) for r in L.dedup_batch(docs(spark, [(1, "beta line\ndelta line\ndelta line"), (2, "gamma line")]), runs).collect())
    assert out == [(1, "delta line")]
    runs.close()
    runs = L.LineRuns.open(spark, at)
    odd = clashing(docs(spark, AWKWARD))
    assert L.dedup_batch(odd, runs).columns == odd.columns
    assert L.dedup_batch(docs(spark, []), runs).isEmpty()
    assert L.dedup_batch(docs(spark, first), runs).isEmpty()
    runs.close()
