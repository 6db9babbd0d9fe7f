"""The pipeline, stage by stage and as a whole, against brute force on a small table with awkward rows."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkwell.llm import bytesops as B
from inkwell.llm import quality
from inkwell.llm.common import shared_dir
from tests.llm.helpers import AWKWARD, clashing, docs, words
from tests.llm.test_decontaminate import plain_spans
from tests.llm.test_linededup import brute as plain_lines
from tests.llm.test_neardup import brute as plain_groups
from tests.llm.test_packing import unpacked

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    given = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs(spark, AWKWARD).withColumn("doc_id", F.col("doc_id") + 100_000)
    copies = given.where("doc_id % 9 = 0").withColumn("doc_id", F.col("doc_id") + 50_000)
    given.unionByName(odd).unionByName(copies).write.parquet(f"{at}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{at}/{t}.parquet")
    return str(at)


def rows_of(df) -> list[tuple]:
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_every_stage_and_the_run(spark, small) -> None:
    current = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    fm = quality.train(current, labels)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        rows = [tuple(r) for r in current.select("doc_id", "text", "lang", "source").collect()]
        plain = [(i, t) for i, t, *_ in rows]
        if k == 0:
            x = quality.features(*B.utf8(pa.array([t for _, t in plain], pa.string())), [pa.array([r[j] for r in rows]) for j in (2, 3)])
            ids, val, off = x
            keep = []
            for r in range(len(rows)):
                i, v = ids[off[r] : off[r + 1]], val[off[r] : off[r + 1]]
                vx = fm.v[i].astype(float) * v[:, None]
                pairs = vx @ vx.T
                keep.append(fm.w0 + (fm.w[i] * v).sum() + (pairs.sum() - np.trace(pairs)) / 2 >= 0)
            want = [r for r, good in zip(plain, keep) if good]
        elif k == 1:
            want = plain_lines(plain)
        elif k == 2:
            gone = plain_groups(plain)
            want = [(i, t) for i, t in plain if i not in gone]
        else:
            want = []
            text = lambda t, spans: words(t) if not spans else [w for j, w in enumerate(words(t)) if not any(s <= j < e for s, e, _ in spans)]
            for i, t in plain:
                spans = plain_spans(t, items)
                if not spans or text(t, spans):
                    want.append((i, text(t, spans)))
        out = stage(spark, current, small)
        assert out.columns == COLUMNS, name
        out.write.parquet(f"{small}/stage{k}")
        current = spark.read.parquet(f"{small}/stage{k}")
        got = rows_of(current)
        if k == 3:
            got = [(i, words(t)) for i, t in got]
        assert sorted(want, key=str) == sorted(got, key=str), name
        assert current.where("not n_chars <=> length(text)").isEmpty()
    whole = corpus_pipeline.run(spark, small).collect()
    last = [(r.doc_id, r.text) for r in current.collect() if r.text]
    ids = [i for i, _ in last]
    assert len(ids) == len(set(ids))
    assert unpacked(whole) == sorted(last, key=str)
    assert not list(Path(shared_dir(spark).removeprefix("file://")).glob("pipeline-*"))


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_empty_and_clashing_tables(spark, small, k: int) -> None:
    stage = corpus_pipeline.STAGES[k][1]
    assert stage(spark, docs(spark, []), small).isEmpty()
    odd = clashing(docs(spark, AWKWARD))
    out = stage(spark, odd, small)
    assert out.count() > 0
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == odd.columns
