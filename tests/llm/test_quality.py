from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa

from inkwell.llm import bytesops as B
from inkwell.llm import quality as Q
from tests.llm.helpers import AWKWARD, clashing, docs


def features(texts):
    n = len(texts)
    return Q.features(*B.utf8(pa.array(texts, pa.string())), [pa.array(["en"] * n), pa.array([None if i % 2 else "s" for i in range(n)], pa.string())])


def test_linear_time_equals_all_pairs() -> None:
    rng = np.random.default_rng(0)
    fm = Q.Machine(0.3, rng.normal(size=Q.SIZE), rng.normal(size=(Q.SIZE, Q.FACTORS)).astype(np.float32))
    ids, val, off = features(["The cat, the CAT 12 !!", None, "", "déjà vu\nab ab ab ab"])
    got = fm.margin(ids, val, off)
    for r in range(4):
        i, x = ids[off[r] : off[r + 1]], val[off[r] : off[r + 1]]
        want = fm.w0 + (fm.w[i] * x).sum() + sum(float(fm.v[a].astype(float) @ fm.v[b].astype(float)) * p * q for (a, p), (b, q) in itertools.combinations(zip(i, x), 2))
        assert abs(got[r] - want) < 1e-3 * max(1, abs(want))


def test_features() -> None:
    ids, val, off = features(["b a a", "a A b", "", None])
    assert ids[: off[1]][:2].tolist() == ids[off[1] : off[2]][:2].tolist()
    assert sorted(val[:2].tolist()) == [1.0, np.log2(3)]
    structure = [set(ids[off[k] : off[k + 1]][ids[off[k] : off[k + 1]] >= 1 << Q.WORD_BITS].tolist()) for k in range(4)]
    assert len(structure[2] ^ structure[3]) == 2 and ids.max() < Q.SIZE


def labelled(spark, n: int, seed: int):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{rng.randrange(2000)}" for _ in range(rng.randint(20, 200))]
        kind = rng.choice(["good", "good", "good", "toxic", "junk"])
        if kind == "toxic":
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scum", "moron"]))
        if kind == "junk":
            w = [x + rng.choice(["***", "$$$"]) for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return rows, labels


def test_held_out_accuracy(spark) -> None:
    rows, labels = labelled(spark, 1500, 1)
    df = docs(spark, rows)
    known = spark.createDataFrame(labels[:1000], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in Q.keep_good(clashing(df), known).select("doc_id").collect()}
    held = labels[1000:]
    right = sum((i in kept) == (q == 1 and t == 0) for i, q, t in held)
    assert right / len(held) > 0.95


def test_sample_does_not_depend_on_partitions(spark) -> None:
    rows, labels = labelled(spark, 200, 2)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a = Q.train(docs(spark, rows).repartition(1), known, sample=60)
    b = Q.train(docs(spark, rows[::-1]).repartition(7), known.repartition(3), sample=60)
    assert a.w0 == b.w0 and (a.w == b.w).all() and (a.v == b.v).all()


def test_awkward_tables(spark) -> None:
    df = clashing(docs(spark, AWKWARD))
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (6, 1, 0), (7, 1, 1), (8, 1, 0), (1, 0, 0), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    scored = Q.score(df, Q.train(df, labels), name="s").select("doc_id", "s").collect()
    assert len(scored) == len(AWKWARD) and all(0 <= r.s <= 1 for r in scored)
    assert len({r.s for r in scored if r.doc_id == 8}) == 1
    kept = Q.keep_good(df, labels)
    assert kept.columns == df.columns
    assert Q.keep_good(df, labels.limit(0)).count() == len(AWKWARD)
    assert Q.keep_good(df, labels.where("quality = 1 and toxic = 0")).count() == len(AWKWARD)
    assert Q.keep_good(docs(spark, []), labels).isEmpty()
    assert Q.keep_good(df.drop("lang", "source"), labels).count() >= 0
