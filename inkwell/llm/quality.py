"""Quality classifier (operator 2): a factorisation machine over hashed words, structure statistics and metadata.

score(x) = w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, in time linear in the non-zero x by
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

Features of a document: its distinct words, hashed to `2**WORD_BITS` places, valued by log(1 + count);
the shares of letters, capitals, digits, punctuation, other symbols, short words and repeated words or lines, mean word and line
length and size, each put into one of `BINS` places; and hashes of the metadata columns that exist (language, source). It is
trained in numpy by AdaGrad on at most `sample` labelled documents (those of least hash of the id, so the sample does not depend
on the order or the number of partitions); a document is good if its quality label is 1 and it is not labelled toxic.
Scoring covers every document and its whole text.

Defined results: NULL or empty texts have no words and only their structure counts; NULL metadata is a value of its own; a
label row with NULL in any of its columns is ignored, and several rows of one id count as bad if any of them is; without labels
of both kinds nothing can be learnt, so every score is 0.5 and every document is kept; an empty table gives no rows. Repeated
rows get equal scores. Columns that clash with own names are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import bytesops as B

WORD_BITS = 18
BINS = 16
FACTORS = 6
#: Words of fewer documents of the sample than this carry no weight.
MIN_DOCS = 4
LEAST_G = 12.0
WORD_SCALE = 1.0
#: At most so many labelled documents are fitted; the bound does not depend on the input.
SAMPLE = 16384
#: Documents of at least this score are kept.
KEEP = 0.5
META = ("lang", "source")

_CLASS = np.full(256, 4, np.uint8)  # 0 lower and non-ASCII letters, 1 capitals, 2 digits, 3 common punctuation, 4 other symbols, 5 white space
_CLASS[97:123] = 0
_CLASS[128:] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in ".,;:'\"-?()"]] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 5
N_STATS = 12
SIZE = (1 << WORD_BITS) + N_STATS * BINS + (1 << 12)


def _sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.zeros(len(x) + 1, np.float64)
    np.cumsum(x, out=c[1:])
    return np.diff(c[off])


def features(buf: np.ndarray, off: np.ndarray, meta: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: places, values and offsets."""
    m = len(off) - 1
    h, s, e, w = B.words(buf, off)
    text = np.repeat(np.arange(m), np.diff(w))
    # distinct words of each text with counts
    place = (h >> B.U(64 - WORD_BITS)).astype(np.int64)
    key = np.sort((text << WORD_BITS) | place)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    wt, wp = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    wx = WORD_SCALE * np.log2(1 + count)
    # structure
    size = np.diff(off).astype(np.float64)
    kind = _CLASS[buf]
    share = [_sums(kind == k, off) / np.maximum(size, 1) for k in (1, 2, 3, 4, 5)]
    lines = _sums(buf == 10, off) + 1
    nw = np.diff(w).astype(np.float64)
    length = (e - s).astype(np.float64)
    own = np.bincount(wt, minlength=m)
    stats = [
        *share,
        _sums(length, w) / np.maximum(nw, 1) / 12,
        _sums(length <= 2, w) / np.maximum(nw, 1),
        own / np.maximum(nw, 1),
        np.log1p(size) / 14,
        np.log1p(size / lines) / 9,
        np.log1p(lines) / 8,
        np.bincount(wt, count > 3, m) / np.maximum(own, 1),
    ]
    bins = np.stack([np.clip((np.sqrt(np.clip(v, 0, 1)) * BINS).astype(np.int64), 0, BINS - 1) + k * BINS for k, v in enumerate(stats)], axis=1) + (1 << WORD_BITS)
    rows = [bins]
    for k, col in enumerate(meta):
        mb, mo = B.utf8(col)
        null = np.asarray(col.is_null()) if col.null_count else np.zeros(m, bool)
        hm = B.mix(B.span_hash(mb, mo[:-1], mo[1:]), 11 + k) if len(mb) else B.mix(np.zeros(m, B.U), 11 + k)
        rows.append((np.where(null, k, (hm >> B.U(52)).astype(np.int64)) + (1 << WORD_BITS) + N_STATS * BINS)[:, None])
    dense = np.concatenate(rows, axis=1)
    per = dense.shape[1]
    many = own + per
    out = np.concatenate([[0], np.cumsum(many)])
    ids, val = np.empty(out[-1], np.int64), np.empty(out[-1], np.float64)
    at = np.arange(len(wt)) - np.concatenate([[0], np.cumsum(own)])[wt] + out[wt]
    ids[at], val[at] = wp, wx
    at = (out[1:] - per)[:, None] + np.arange(per)
    ids[at], val[at] = dense, 1.0
    return ids, val, out


@dataclass
class Machine:
    """A fitted factorisation machine."""

    w0: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, ids: np.ndarray, val: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Linear-time scores of sparse rows (every row has a place)."""
        if len(off) == 1:
            return np.zeros(0)
        at = off[:-1]
        vx = self.v[ids] * val[:, None].astype(np.float32)
        s = np.add.reduceat(vx, at, axis=0, dtype=np.float64)
        q = np.add.reduceat(np.einsum("if,if->i", vx, vx), at, dtype=np.float64)
        return self.w0 + np.add.reduceat(self.w[ids] * val, at) + 0.5 * ((s * s).sum(axis=1) - q)


def telling(ids: np.ndarray, label: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places that the machine uses: words of at least MIN_DOCS documents whose G statistic against the label is at least LEAST_G, and all others that occur."""
    n = np.bincount(ids, minlength=SIZE).astype(np.float64)
    g = np.bincount(ids, label, SIZE)
    total = np.zeros(SIZE)
    for seen, of in ((g, y.sum()), (n - g, len(y) - y.sum())):
        for k, expected in ((seen, n * of / len(y)), (of - seen, (len(y) - n) * of / len(y))):
            total += 2 * k * np.log(np.maximum(k, 1e-12) / np.maximum(expected, 1e-12))
    word = np.arange(SIZE) < 1 << WORD_BITS
    return np.where(word, (n >= MIN_DOCS) & (total >= LEAST_G), n > 0)


def fit(ids: np.ndarray, val: np.ndarray, off: np.ndarray, y: np.ndarray, *, factors: int = FACTORS, epochs: int = 10, batch: int = 32, rate: float = 0.1, l2: float = 1e-4, seed: int = 1) -> Machine:
    """AdaGrad on the logistic loss; classes weigh the same in sum."""
    rng = np.random.default_rng(seed)
    m = len(y)
    often = telling(ids, np.repeat(y, np.diff(off)), y)
    text, keep = np.repeat(np.arange(m), np.diff(off)), often[ids]
    ids, val, off = ids[keep], val[keep], np.concatenate([[0], np.cumsum(np.bincount(text[keep], minlength=m))])
    fm = Machine(0.0, np.zeros(SIZE), (rng.normal(0, 0.01, (SIZE, factors)) * often[:, None]).astype(np.float32))
    gw, gv, g0 = np.full(SIZE, 1e-2), np.full((SIZE, factors), 1e-2, np.float32), 1e-2
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    many = np.diff(off)
    for _ in range(max(epochs, -(-400 * batch // m))):
        order = rng.permutation(m)
        for b in range(0, m, batch):
            rows = order[b : b + batch]
            n = many[rows]
            o = np.concatenate([[0], np.cumsum(n)])
            at = np.arange(o[-1]) - np.repeat(o[:-1], n) + np.repeat(off[rows], n)
            i, x = ids[at], val[at]
            p = 1 / (1 + np.exp(-fm.margin(i, x, o)))
            d = (p - y[rows]) * weight[rows] / len(rows)
            dx = np.repeat(d, n) * x
            vx = fm.v[i] * x[:, None].astype(np.float32)
            s = np.repeat(np.add.reduceat(vx, o[:-1], axis=0), n, axis=0)
            u, inv = np.unique(i, return_inverse=True)
            dw = np.bincount(inv, dx, len(u)) + l2 * fm.w[u]
            dv = np.stack([np.bincount(inv, dx * (s[:, f] - vx[:, f]), len(u)) for f in range(factors)], axis=1).astype(np.float32) + np.float32(l2) * fm.v[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            g0 += d.sum() ** 2
            fm.w[u] -= rate * dw / np.sqrt(gw[u])
            fm.v[u] -= np.float32(rate * 0.1) * dv / np.sqrt(gv[u])
            fm.w0 -= rate * 0.1 * d.sum() / np.sqrt(g0)
    return fm


def _meta(docs: DataFrame, columns: tuple[str, ...]) -> list:
    return [F.col(f"`{c}`").cast("string").alias(f"m{k}") for k, c in enumerate(columns) if c in docs.columns]


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", meta: tuple[str, ...] = META) -> Machine | None:
    """Fits the machine; None if the labels are of one kind only."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min(good.cast("int")).alias("y"))
    some = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(sample))
    cols = _meta(docs, meta)
    n_meta = len(cols)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), *cols).join(some, "id").dropDuplicates(["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, off in B.steps(batches, "t"):
            ids, val, o = features(buf, off, [part.column(2 + k) for k in range(n_meta)])
            packed = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(a)) for a in (ids.astype(np.int32), val.astype(np.float32))]
            yield pa.record_batch([part.column(0), part.column(part.num_columns - 1), *packed], ["id", "y", "i", "x"])

    got = rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, y int, i array<int>, x array<float>").toArrow().sort_by("id")
    y = got["y"].to_numpy()
    if len(y) == 0 or y.min() == y.max():
        return None
    i, x = got["i"].combine_chunks(), got["x"].combine_chunks()
    if isinstance(i, pa.ChunkedArray):
        i, x = pa.concat_arrays(i.chunks), pa.concat_arrays(x.chunks)
    return fit(i.flatten().to_numpy().astype(np.int64), x.flatten().to_numpy().astype(np.float64), np.concatenate([[0], np.cumsum(i.value_lengths().to_numpy())]), y)


def score(docs: DataFrame, machine: Machine | None, *, text_col: str = "text", meta: tuple[str, ...] = META, name: str = "score") -> DataFrame:
    """docs with a column `name` of scores from 0 (bad) to 1 (good)."""
    if machine is None:
        return docs.withColumn(name, F.lit(0.5))
    sent = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w.astype(np.float32), machine.v))
    cols = _meta(docs, meta)

    @F.arrow_udf("double")
    def rate(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        fm = Machine(*sent.value)
        for row in columns:
            t, *m = row if isinstance(row, tuple) else (row,)  # one column alone comes without a tuple
            batch = pa.record_batch([t, *m], ["t", *[f"m{k}" for k in range(len(m))]])
            out = [fm.margin(*features(buf, off, part.columns[1:])) for part, buf, off in B.steps(iter([batch]), "t")]
            yield pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(out) if out else np.zeros(0), -60, 60))))

    return docs.withColumn(name, rate(F.col(f"`{text_col}`").cast("string"), *cols))


def keep_good(docs: DataFrame, labels: DataFrame, *, keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    scored = score(docs, train(docs, labels, sample=sample), name="__ink_score")
    return scored.where(F.col("__ink_score") >= keep).select(*[F.col(f"`{c}`") for c in docs.columns])
