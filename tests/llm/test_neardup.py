from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from inkwell.llm import bytesops as B
from inkwell.llm import neardup as N
from inkwell.llm.components import components
from tests.llm.helpers import AWKWARD, clashing, docs, words


def shingle_set(text: str | None) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + N.WIDTH]) for i in range(max(1, len(w) - N.WIDTH + 1))) if w else frozenset()


def brute(rows, threshold: float = N.THRESHOLD) -> dict[int, int]:
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and len(x & y) / len(x | y) >= threshold:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in root if find(i) != i}


def result(df) -> dict[int, int]:
    rows = df.collect()
    assert len(rows) == len({r.doc_id for r in rows})
    return {r.doc_id: r.kept_doc_id for r in rows}


def corpus(seed: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    vocab = [f"v{k}" for k in range(400)]
    rows: list[tuple[int, str]] = []
    shared = rng.choices(vocab, k=60)
    for g in range(25):
        base = rng.choices(vocab, k=rng.randint(3, 120)) + (shared if g % 3 == 0 else [])
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append((len(rows) * 3 + 1, " ".join(own).title() if rng.random() < 0.3 else "  ".join(own) + "!"))
    rng.shuffle(rows)
    return rows


def test_equals_all_pairs(spark) -> None:
    rows = corpus(1) + corpus(2)[:0]
    assert result(N.near_duplicates(docs(spark, rows))) == brute(rows)


def test_large_group_of_near_copies(spark) -> None:
    """A bucket of many copies, chains whose ends differ, and a stranger in the bucket."""
    rng = random.Random(4)
    base = [f"b{k}" for k in range(300)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(6):
            own[rng.randrange(300)] = f"u{rng.random()}"
        rows.append((i, " ".join(own)))
    chain = list(base)
    for i in range(150, 170):
        chain[(i - 150) * 10 : (i - 150) * 10 + 8] = [f"c{i}{k}" for k in range(8)]
        rows.append((i, " ".join(chain)))
    assert result(N.near_duplicates(docs(spark, rows))) == brute(rows)


def test_boilerplate_in_a_bucket(spark) -> None:
    """Many texts share a passage, too little to be alike; among them are pairs that are, which no bucket's least id shows."""
    rng = random.Random(7)
    shared = [f"s{k}" for k in range(40)]
    rows = []
    for i in range(120):
        own = [f"o{i if i % 10 else i // 20}x{k}" for k in range(70)]
        rows.append((i, " ".join(shared + own if i % 2 else own + shared)))
    for i in range(120, 160):
        own = shared + [f"o{i // 4}x{k}" for k in range(30)]
        own[rng.randrange(70)] = f"u{i}"
        rows.append((i, " ".join(own)))
    want = brute(rows)
    assert len(want) > 30
    assert result(N.near_duplicates(docs(spark, rows))) == want
    # one row a bucket: every pair must then come from the join of prefixes
    assert result(N.near_duplicates(docs(spark, rows), bands=60, rows=1)) == want


def test_awkward_tables(spark) -> None:
    rows = AWKWARD + [(20, "ONE!"), (21, "ünïcödé wörds 漢字 😀 MIXED.")]
    want = brute(rows)
    assert want == {20: 5, 21: 6}
    assert result(N.near_duplicates(clashing(docs(spark, rows)))) == want
    assert result(N.near_duplicates(docs(spark, rows), id_blocks=1, id_bits=1)) == want
    assert result(N.near_duplicates(docs(spark, []))) == {}


def test_circulant_signature() -> None:
    """Every coordinate is the second permutation of the first's value shifted by its number; agreement estimates Jaccard."""

    def perm(x: int, a: int, b: int) -> int:
        x = x * a & 0xFFFFFFFF
        x ^= x >> 15
        x = x * b & 0xFFFFFFFF
        return x ^ x >> 13

    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    a, b = x[:700], x[300:]
    sig = N.signature(np.concatenate([a, b]), np.array([0, 700, 700, 1400]), 128)
    plain = [min(perm((perm(int(v) >> 32, 0x9E3779B1, 0x85EBCA77) - k) & 0xFFFFFFFF, 0xC2B2AE3D, 0x27D4EB2F) for v in a) for k in range(1, 129)]
    assert sig[0].tolist() == plain and (sig[1] == 0xFFFFFFFF).all()
    assert abs((sig[0] == sig[2]).mean() - 0.4) < 0.13


def test_words_and_shingles() -> None:
    texts = ["A b c", None, "", "Élan VITAL, été—x", "a b c d e f g", "é"]
    buf, off = B.utf8(pa.array(texts))
    h, s, e, w = B.words(buf, off)
    low = B.fold(buf)
    got = [[bytes(low[a:b]).decode() for a, b in zip(s[i:j], e[i:j])] for i, j in zip(w[:-1], w[1:])]
    assert got == [words(t) for t in texts]
    _, so = N.shingles(h, w, 5)
    assert np.diff(so).tolist() == [1, 0, 0, 1, 3, 1]


def test_components(spark) -> None:
    rng = random.Random(9)
    pairs = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(5, 5), (None, 3)]
    got = {r.id: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root: dict[int, int] = {}

    def find(i: int) -> int:
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        if a is not None and a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    assert got == {i: find(i) for i in root}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()
