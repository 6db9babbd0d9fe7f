"""What makes work or memory grow faster than the tables: batches worked on whole, texts analysed twice, tokens shuffled."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell import queries
from inkwell.functions import analysis
from inkwell.operators import postings as P
from inkwell.operators.search import matches
from inkwell.plans.parser import parse

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, path string, extension string, size_bytes long, mtime timestamp_ntz, doc_type string, text string"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def peak(work) -> int:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_grouping_works_in_steps(monkeypatch) -> None:
    """merge_segments, index_search: beyond the result, numpy's memory does not grow with the batch."""
    lists = pa.array([[f"w{(i * k) % 977}" for k in range(200)] for i in range(10_000)])
    assert peak(lambda: P.group_terms(lists)) < 30 * 2_000_000
    lists = pa.array([["b", "a", "b"], None, [], ["c"], ["a", "a"], ["b"]])
    whole = P.group_terms(lists).to_pylist()
    assert sorted((x["term"], x["tf"], x["positions"]) for x in whole[0]) == [("a", 1, [1]), ("b", 2, [0, 2])]
    for n in (1, 2, 4):
        monkeypatch.setattr(P, "STEP_TOKENS", n)
        got = P.group_terms(lists).to_pylist()
        assert [sorted(map(str, r)) for r in got] == [sorted(map(str, r)) for r in whole]
    assert P.group_terms(pa.array([], pa.list_(pa.string()))).to_pylist() == []


def test_offsets_work_in_steps(monkeypatch) -> None:
    """token_offsets: no Python object a token; the same tokens as one text at a time, for any step."""
    texts = pa.array(["one two three 44 " * 100] * 1000)
    assert peak(lambda: analysis.analyze_batch(texts)) < 150 * 400_000
    rng = random.Random(1)
    some = [None, "", "a", "中", "The fox 中文 of", *("".join(rng.choices("aBz09 .\n中文あ한ｶ々😀𠀀éİK", k=rng.randrange(40))) for _ in range(2000))]
    for step in (1, 500, 1 << 20):
        monkeypatch.setattr(analysis, "STEP_BYTES", step)
        for stop in (False, True):
            assert analysis.analyze_batch(pa.array(some), stop).to_pylist() == [[t._asdict() for t in analysis.analyze(x, stop)] for x in some]


def test_mixed_terms_in_one_expression(spark) -> None:
    """tokens_mixed: each text is analysed once; the same terms as one text at a time."""
    assert plan(queries.tokens_mixed(spark, SF)).count("octet_length") == 1
    assert plan(queries.tokens(spark, SF)).count("octet_length") == 1
    rng = random.Random(2)
    some = [None, "", "中", "a中", "中a 文ab", "İK中", *("".join(rng.choices("aBz09 .\n中文あ한ｶ々😀𠀀éİK", k=rng.randrange(40))) for _ in range(500))]
    rows = spark.createDataFrame(list(enumerate(some)), "i int, t string").select("i", analysis.terms(F.col("t")).alias("a"), analysis.terms(F.col("t"), True).alias("b"))
    for r in rows.collect():
        assert [r.a, r.b] == [[t.term for t in analysis.analyze(some[r.i], stop)] for stop in (False, True)]


@pytest.mark.parametrize("name", ["postings", "delta_round_trip"])
def test_postings_without_a_shuffle(spark, name) -> None:
    assert "Aggregate" not in plan(queries.queries()[name](spark, SF))


def test_frequencies_by_one_aggregate(spark) -> None:
    """global_df: no set of terms and documents is kept."""
    assert plan(queries.global_df(spark, SF)).count("Aggregate") == 1


def test_repeated_ids_are_one_document(spark) -> None:
    content = spark.createDataFrame([(1, "aa bb aa"), (1, "bb cc"), (2, None), (None, "aa"), (None, "aa dd"), (3, "")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.term, r.tf, r.positions) for r in P.postings(content).collect())
    assert got == [("1", "aa", 2, [0, 2]), ("1", "bb", 2, [0, 1]), ("1", "cc", 1, [1]), ("None", "aa", 2, [0, 0]), ("None", "dd", 1, [1])]


@pytest.mark.parametrize("name", ["topk", "sort_size", "bool_repeat", "prefix_bm25", "phrase3"])
def test_search_analyses_texts_once(spark, name) -> None:
    """What is left to read of a search's plan is what one pass over the texts kept."""
    assert "regexp_extract_all(lower(translate" not in plan(queries.queries()[name](spark, SF))


def test_search_of_odd_tables(spark) -> None:
    """One pass gives the same scores as counting in written postings: repeated ids, no text, no rows."""
    rows = [(1, "aa bb aa"), (1, "bb cc"), (2, None), (3, ""), (4, "bb aa bb"), (5, "x y z")]
    for own in (rows, rows[2:4], []):
        files = spark.createDataFrame([(i, f"/p{k}", "md", 1, None, "DOC", t) for k, (i, t) in enumerate(own)], DOCS)
        once = P.IndexTables.of(files)
        counted = P.IndexTables(once.docs, once.content, P.IndexTables.of(files).postings)
        for q in ("aa", "aa OR bb", '"aa bb"', "b* AND NOT cc", "NOT zz"):
            a, b = (sorted((r.path, round(r.score, 9)) for r in matches(t, parse(q)).collect()) for t in (once, counted))
            assert a == b


def test_offsets_go_out_in_steps(spark, monkeypatch) -> None:
    """token_offsets: no generator over arrays of a batch's tokens; rows have their own document's id."""
    assert "Generate" not in plan(queries.token_offsets(spark, SF))
    texts = [(7, "aa b cc"), (3, None), (3, ""), (None, "dd"), (5, "中文 ee")]
    got = {(r.doc_id, r.term, r.pos, r.start, r.end) for r in analysis.token_rows(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {(i, *t) for i, x in texts for t in analysis.analyze(x)}
