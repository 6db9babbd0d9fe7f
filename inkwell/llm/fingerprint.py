"""Document fingerprints (operator 3): locally consistent parsing by deterministic coin tossing.

A text's bytes are symbols of level 0. Each level is parsed in two moves. Runs of one symbol become one symbol named after the
symbol and the run's length, so no two neighbours are equal. Then deterministic coin tossing labels every symbol by the lowest
bit in which it differs from the one before it, and that bit's value; four rounds bring 64-bit names to labels below 6, and three
sweeps to labels below 3, still unequal between neighbours. Local maxima, and local minima next to no maximum, begin phrases of
two or three symbols (four at a text's edges). A phrase's name, a hash of its symbols, is a symbol of the next level.

Where phrases begin depends on a few neighbours only, so equal substrings, at whatever offsets, are parsed alike but for a margin
at both ends, and share the names of their interior phrases at every level; the margins add up over the levels. A fingerprint has the names of `level`
(about 80 bytes a phrase at level 5) as signatures, those of `fine` as fine signatures, in which shared passages of 50 words meet
that are too short for `level` (but for some that only repeat a few words), and the name of the whole text as root.

Defined results: NULL and empty texts have no signatures, no levels and root 0; equal texts, and only those (but for collisions of
64-bit hashes), have equal roots; a text too short for the level has its root as the only signature; repeated rows have equal
fingerprints; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import bytesops as B

LEVEL = 5
FINE = 4
ROUNDS = 4
_LOWBIT = np.array([(x & -x).bit_length() - 1 if x else 0 for x in range(256)], np.uint8)


def _runs(x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of equal symbols as one symbol each."""
    head = np.ones(len(x), bool)
    head[1:] = x[1:] != x[:-1]
    head[off[:-1][np.diff(off) > 0]] = True
    at = np.flatnonzero(head)
    if len(at) == len(x):
        return x, off
    many = np.diff(np.append(at, len(x)))
    out = x[at]
    long = np.flatnonzero(many > 1)
    out[long] = B.mix(out[long] ^ B.mix(many[long].astype(B.U), 3), 5)
    return out, np.searchsorted(at, off)


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 3, unequal between neighbours of one text; `first` are the places where texts begin."""
    one = B.U(1)
    d = x.copy()
    d[1:] ^= x[:-1]
    d[first] = one  # the first symbol counts as differing in bit 0
    bit = np.bitwise_count((d & -d) - one).astype(B.U)
    y = ((bit << one) | ((x >> bit) & one)).astype(np.uint8)
    for _ in range(ROUNDS - 1):
        e = y.copy()
        e[1:] ^= y[:-1]
        e[first] = 1
        bit = _LOWBIT[e]
        y = (bit << 1) | ((y >> bit) & 1)
    # sweeps: labels 5, 4, 3 take the least that neither neighbour has
    for big in (5, 4, 3):
        at = np.flatnonzero(y == big)
        if not len(at):
            continue
        left = np.where(np.isin(at, first, assume_unique=True), 9, y[np.maximum(at - 1, 0)])
        right = np.where(np.isin(at + 1, first, assume_unique=True) | (at + 1 == len(y)), 9, y[np.minimum(at + 1, len(y) - 1)])
        y[at] = np.where((left != 0) & (right != 0), 0, np.where((left != 1) & (right != 1), 1, 2))
    return y


def parse_level(x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the next level, and the texts' offsets in them."""
    x, off = _runs(x, off)
    n = len(x)
    if not n:
        return x, off
    size = np.diff(off)
    first = off[:-1][size > 0]
    y = _labels(x, first).astype(np.int8)
    # beyond a text's edges there is nothing, less than any label for maxima and more for minima
    edge_l = np.zeros(n, bool)
    edge_l[first] = True
    edge_r = np.zeros(n, bool)
    edge_r[off[1:][size > 0] - 1] = True
    left, right = np.empty(n, np.int8), np.empty(n, np.int8)
    left[1:], right[:-1] = y[:-1], y[1:]
    left[0] = right[-1] = 0
    top = (edge_l | (left < y)) & (edge_r | (right < y))
    near = top.copy()
    near[1:] |= top[:-1] & ~edge_l[1:]
    near[:-1] |= top[1:] & ~edge_r[:-1]
    low = ~edge_l & ~edge_r & (left > y) & (right > y) & ~near
    begin = top | low
    # a text's first phrase takes in what stands before its first landmark
    second = first[size[size > 0] > 1] + 1
    begin[first] = True
    begin[second] = False
    at = np.flatnonzero(begin)
    many = np.diff(np.append(at, n))
    name = B.mix(many.astype(B.U), 1)
    for j in range(int(many.max())):
        on = many > j
        if on.all():
            name = B.mix(name * B.U(0xD6E8FEB86659FD93) + x[at + j], 2)
        else:
            k = np.flatnonzero(on)
            name[k] = B.mix(name[k] * B.U(0xD6E8FEB86659FD93) + x[at[k] + j], 2)
    return name, np.searchsorted(at, off)


def signed(buf: np.ndarray, off: np.ndarray, levels: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """For texts in bytes: levels until one name is left, that name, and for each of `levels` flat sorted distinct signatures with offsets."""
    m = len(off) - 1
    x = B.mix(buf.astype(B.U), 9)
    depth, root = np.zeros(m, np.int64), np.zeros(m, B.U)
    sig: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in levels]
    ids, at = np.arange(m), off
    k = 0
    while len(ids):
        size = np.diff(at)
        done = size <= 1
        one = done & (size == 1)
        root[ids[one]] = x[at[:-1][one]]
        depth[ids[one]] = k
        for level, own in zip(levels, sig):
            if k == level:
                own.append((np.repeat(ids, size), x))
            if k < level:
                own.append((ids[one], x[at[:-1][one]]))
        if done.any():
            stay = np.repeat(~done, size)
            x, ids, at = x[stay], ids[~done], np.concatenate([[0], np.cumsum(size[~done])])
        if not len(ids):
            break
        x, at = parse_level(x, at)
        k += 1
    return depth, root, [_distinct(own, m) for own in sig]


def _distinct(sig: list[tuple[np.ndarray, np.ndarray]], m: int) -> tuple[np.ndarray, np.ndarray]:
    text, value = np.concatenate([t for t, _ in sig] or [np.zeros(0, np.int64)]), np.concatenate([v for _, v in sig] or [np.zeros(0, B.U)])
    o = np.lexsort((value.view(np.int64), text))
    text, value = text[o], value[o]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    text, value = text[new], value[new]
    return value, np.searchsorted(text, np.arange(m + 1))


def fingerprint(buf: np.ndarray, off: np.ndarray, level: int = LEVEL) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same of one level: levels, root, signatures, offsets."""
    depth, root, [(value, o)] = signed(buf, off, (level,))
    return depth, root, value, o


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", level: int = LEVEL, fine: int = FINE) -> DataFrame:
    """(doc_id, n_bytes, n_levels, root, signatures, fine_signatures) of every document; each text is parsed where it is, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, off in B.steps(batches, "t"):
            depth, root, sig = signed(buf, off, (level, fine))
            yield pa.record_batch([part.column(0), pa.array(np.diff(off)), pa.array(depth.astype(np.int32)), pa.array(root.view(np.int64)), *(B.ragged(*x) for x in sig)], ["doc_id", "n_bytes", "n_levels", "root", "signatures", "fine_signatures"])

    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return src.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_levels int, root long, signatures array<long>, fine_signatures array<long>")


def shared_passages(prints: DataFrame) -> DataFrame:
    """(signature, documents) of the fine signatures that several documents have; one shuffle with partial counts."""
    return prints.select("doc_id", F.explode("fine_signatures").alias("signature")).groupBy("signature").agg(F.count("*").alias("documents")).where("documents > 1")
