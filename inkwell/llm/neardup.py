"""Near duplicates (operator 4): circulant MinHash, banding and exact Jaccard verification.

A text's shingles are its runs of `width` words (a shorter text is one shingle). Two permutations of the 2**32 hashed shingles
give all coordinates: the first scatters, the second is applied to the first's value shifted circularly by k for the k-th
coordinate. `bands` bands of `rows` coordinates make candidates; every candidate pair is verified by the exact Jaccard
similarity of the 64-bit shingle sets, and groups are the connected components of the pairs at `threshold` or more.

No candidate is dropped. Texts with the same sequence of words are first represented by the least id. In every bucket the
members are then verified against its least id, so a bucket of many copies costs one comparison a member. What is left are pairs
of members of one bucket that this put into different groups. They come from a prefix join, which loses none of them: under an
order of the shingles by the number of such texts that have them, two texts of the threshold share one of the first
n - ceil(threshold * n) + 1 of each. Shingles of one group alone come first and need no join, so texts that share a boilerplate
bucket and little else meet nowhere, and a bucket costs no square of its members. Pairs whose set sizes, or what is left of the
sets behind the shared shingle, cannot give the threshold are settled by that. With 42 bands of 3 rows a pair at 0.5 is missed
with probability (1 - 0.5**3)**42 = 0.004, and one at 0.7 with 4e-8.

Sets of shingles are made of the texts whose id may be a candidate's by a Bloom filter of bounded size, so no text is ever shuffled.

Defined results: NULL or empty texts and texts without words have no duplicates; of equal texts (ties) the least id stays; NULL
ids are ignored; an empty table gives no groups. Rows that share an id stay or go together: the id goes if any of them is in a
group with a lesser id. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import bytesops as B
from inkwell.llm.common import Scratch, cut
from inkwell.llm.components import components
from inkwell.llm.urlfilter import filled, may_contain

WIDTH = 3
BANDS, ROWS = 42, 3
#: Copies with one word in ten changed have a similarity of about (0.9**3) / (2 - 0.9**3) = 0.57.
THRESHOLD = 0.5
#: Bits of the Bloom filter for a candidate id, and its blocks of 64 bytes at most; false positives cost a set that nothing reads.
ID_BITS, ID_BLOCKS = 16, 1 << 21


def shingles(h: np.ndarray, w: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit shingle hashes of all texts, repeats included, and the texts' offsets in them."""
    n = np.diff(w)
    many = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    off = np.concatenate([[0], np.cumsum(many)])
    first = np.arange(off[-1]) + np.repeat(w[:-1] - off[:-1], many)
    length = np.repeat(np.minimum(n, width), many)
    out = np.zeros(off[-1], B.U)
    short = length < width
    any_short = bool(short.any())
    for j in range(width):
        at = np.minimum(first + j, max(len(h) - 1, 0))
        nxt = (out * B.U(0xC2B2AE3D27D4EB4F)) + h[at]
        out = np.where(length > j, nxt, out) if any_short else nxt
    return B.mix(out, 7), off


def _permute(x: np.ndarray, a: int, b: int, tmp: np.ndarray) -> np.ndarray:
    """A permutation of 2**32, in place."""
    x *= np.uint32(a)
    np.right_shift(x, np.uint32(15), out=tmp)
    x ^= tmp
    x *= np.uint32(b)
    np.right_shift(x, np.uint32(13), out=tmp)
    x ^= tmp
    return x


def signature(items: np.ndarray, off: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash, (texts, coordinates) of uint32; texts without shingles keep the largest value."""
    out = np.full((len(off) - 1, coordinates), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(off))
    # Blocks that stay in the cache: whole texts, about 32k shingles
    a = 0
    while a < len(full):
        b = max(a + 1, int(np.searchsorted(off[full], off[full[a]] + 32768, "right")) - 1)
        x = (items[off[full[a]] : off[full[b - 1] + 1]] >> B.U(32)).astype(np.uint32)
        tmp, y, at = np.empty_like(x), np.empty_like(x), off[full[a:b]] - off[full[a]]
        sigma = _permute(x, 0x9E3779B1, 0x85EBCA77, tmp)
        for k in range(coordinates):
            np.subtract(sigma, np.uint32(k + 1), out=y)
            out[full[a:b], k] = np.minimum.reduceat(_permute(y, 0xC2B2AE3D, 0x27D4EB2F, tmp), at)
        a = b
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) of uint64: a hash of each band's coordinates and its number."""
    out = np.empty((len(sig), bands), B.U)
    for b in range(bands):
        x = np.full(len(sig), b + 1, B.U)
        for r in range(rows):
            x = B.mix(x * B.U(0x9E3779B97F4A7C15) + sig[:, b * rows + r].astype(B.U))
        out[:, b] = x
    return out


def _sign(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, off in B.steps(batches, "t"):
            h, _, _, w = B.words(buf, off)
            items, so = shingles(h, w, width)
            keys = band_keys(signature(items, so, bands * rows), bands, rows)
            p, inv = B._powers(len(h))
            s = []
            for seed in (1, 2):
                c = np.zeros(len(h) + 1, B.U)
                np.cumsum(B.mix(h, seed) * p[: len(h)], out=c[1:])
                s.append(B.mix((c[w[1:]] - c[w[:-1]]) * inv[w[:-1]], seed).view(np.int64))
            flat = B.ragged(keys.ravel(), np.arange(len(keys) + 1) * bands)
            yield pa.record_batch([part.column(0), *map(pa.array, s), flat], ["id", "s1", "s2", "keys"]).filter(pa.array(np.diff(so) > 0))

    return docs.mapInArrow(run, "id long, s1 long, s2 long, keys array<long>")


def _possible(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = may_contain(table, B.mix(b.column(0).to_numpy().view(B.U)).view(np.int64))
        if keep.any():
            yield b if keep.all() else b.filter(pa.array(keep))


def shingle_sets(docs: DataFrame, width: int = WIDTH, ids: np.ndarray | None = None) -> DataFrame:
    """(id, n, sh): the n sorted distinct shingle hashes of texts (id, t); with a filter of ids, of those that may be in it."""
    sent = None if ids is None else docs.sparkSession.sparkContext.broadcast(ids)  # ID_BLOCKS bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sent is not None:
            batches = _possible(batches, sent.value)
        for part, buf, off in B.steps(batches, "t"):
            h, _, _, w = B.words(buf, off)
            items, so = shingles(h, w, width)
            text = np.repeat(np.arange(len(so) - 1), np.diff(so))
            o = np.lexsort((items, text))
            v, t = items[o], text[o]
            new = np.ones(len(v), bool)
            new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
            v, t = v[new], t[new]
            o = np.searchsorted(t, np.arange(len(so)))
            yield pa.record_batch([part.column(0), pa.array(np.diff(o)), B.ragged(v, o)], ["id", "n", "sh"])

    return docs.mapInArrow(run, "id long, n long, sh array<long>")


def _verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, j) of the pairs whose sets have that Jaccard similarity."""
    size = sets.select(F.col("id").alias("a"), F.col("n").alias("p")), sets.select(F.col("id").alias("b"), F.col("n").alias("q"))
    alike = F.least("p", "q") >= threshold * F.greatest("p", "q")  # an upper bound of the similarity
    pairs = pairs.join(size[0], "a").join(size[1], "b").where(alike).select("a", "b").distinct()
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("sh").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("sh").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.withColumn("c", common).withColumn("j", F.col("c") / (F.size("x") + F.size("y") - F.col("c"))).where(F.col("j") >= threshold).select("a", "b", "j")


def _id_filter(ids: DataFrame, bits: int, blocks: int) -> np.ndarray:
    """A Bloom filter of distinct ids (id), over the hash that `_possible` looks up."""

    @F.arrow_udf("long")
    def mixed(x: pa.Array) -> pa.Array:
        return pa.array(B.mix(x.to_numpy().view(B.U)).view(np.int64))

    return filled(ids.select(mixed("id").alias("h")), ids.count(), bits, blocks)


def _prefix_pairs(split: DataFrame, sets: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of texts (id, g) of different groups g whose sets may have the similarity; none that has it is left out."""
    own = scratch.table(split.join(sets, "id").select("id", "g", "n", F.xxhash64("sh").alias("w"), F.explode("sh").alias("s")))
    shared = own.groupBy("s").agg(F.count("*").alias("many"), F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("s", "many")
    rows = own.join(shared, "s")
    # shingles of a single group are first in the order, though not here: of n shingles they are those before the first rank
    by_text = rows.groupBy("id", "g", "n", "w").agg(F.sort_array(F.collect_list(F.struct("many", "s"))).alias("x"))
    ranked = by_text.select("id", "g", "n", (F.col("n") - F.size("x")).alias("before"), F.posexplode("x").alias("k", "y")).select("id", "g", "n", F.col("y.s").alias("s"), (F.col("before") + F.col("k") + 1).alias("pos"))
    prefix = scratch.table(ranked.where(F.col("pos") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1))
    x, y = (prefix.select("s", *[F.col(c).alias(c + e) for c in ("id", "g", "n", "pos")]) for e in "xy")
    least = F.lit(threshold / (1 + threshold)) * (F.col("nx") + F.col("ny"))  # shingles in common at the threshold
    reach = 1 + F.least(F.col("nx") - F.col("posx"), F.col("ny") - F.col("posy"))
    met = x.join(y, "s").where((F.col("idx") < F.col("idy")) & (F.col("gx") != F.col("gy")) & (F.least("nx", "ny") >= threshold * F.greatest("nx", "ny")) & (reach >= least - 1e-6))
    return met.select(F.col("idx").alias("a"), F.col("idy").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, id_bits: int = ID_BITS, id_blocks: int = ID_BLOCKS) -> DataFrame:
    """(doc_id, kept_doc_id) of every document that goes: kept_doc_id, its class, is the least id of its group, which stays."""
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t")).where("id is not null")
    with Scratch(spark) as scratch:
        signed = scratch.table(_sign(src, width, bands, rows))
        least = scratch.table(signed.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("m")).where("m > 1"))
        same = scratch.table(signed.select("id", "s1", "s2").join(least, ["s1", "s2"]).where("id <> rep").select("id", "s1", "s2", "rep"))
        lone = signed.join(same, ["id", "s1", "s2"], "left_anti")  # other texts of the same id stay
        banded = scratch.table(lone.select("id", F.explode("keys").alias("key")))
        # a bucket's least id, by partial results, joined back: no window gathers a hot bucket
        buckets = scratch.table(banded.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("a")).where("m > 1").select("key", "a"))
        members = scratch.table(banded.join(buckets, "key"))
        pairs = scratch.table(members.select("a", F.col("id").alias("b")).where("a <> b").distinct())
        ids = scratch.table(members.select("id").distinct())
        sets = scratch.table(shingle_sets(src, width, _id_filter(ids, id_bits, id_blocks)))
        near = scratch.table(_verify(pairs, sets, threshold))
        groups = components(near)
        # members of a bucket that the stars left in different groups
        placed = scratch.table(members.join(groups, "id", "left").select("key", "id", F.coalesce("root", "id").alias("g")))
        mixed = scratch.table(placed.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("key"))
        split = scratch.table(placed.join(mixed, "key").select("id", "g").distinct())
        more = scratch.table(_verify(_prefix_pairs(split, sets, threshold, scratch).join(pairs, ["a", "b"], "left_anti"), sets, threshold))
        links = near.select("a", "b").union(more.select("a", "b")).union(same.select(F.col("rep").alias("a"), F.col("id").alias("b")))
        return cut(components(links).where("id <> root").select(F.col("id").alias("doc_id"), F.col("root").alias("kept_doc_id")).distinct())
