"""Benchmark decontamination (operator 9): an FM-index over the words of each training shard.

A shard is a run of consecutive documents of about `shard_bytes` of text. Its words are renamed to integers, suffix-sorted by
prefix doubling, and kept as a Burrows-Wheeler transform in a wavelet matrix with popcount ranks and every `SAMPLE`-th suffix
position. All test phrases (the runs of `n` words of each benchmark item; a shorter item is one phrase) are searched backward
at once, their occurrences are located by walking to sampled positions, and overlapping or touching occurrences merge into one
removal span. Shards are independent, so work and memory follow the text.

What is broadcast is the benchmark, in groups of at most `group` phrases. A shard's index is built once; the groups are searched
in it one after the other, and a worker holds one group at a time. In each, only phrases whose rarest word (within the
group) is in the shard are looked at. Spans are merged after all groups, so the number of groups changes nothing in the result.

Defined results: words are folded (case, punctuation and white space do not matter); NULL or empty texts and texts without words
have no spans; an item without words gives no phrase; repeated items or rows give each document its spans once; an empty table
gives no rows. Columns other than the id and the text are ignored by `find_spans`, and kept by `decontaminate` and
`remove_spans`. `decontaminate` cuts every row by its own spans, where it is; `remove_spans` tells rows apart by their ids, so
rows that share an id are cut alike, by all of their spans, and rows without an id stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm import bytesops as B
from inkwell.llm.common import cut

N_WORDS = 8
SHARD_BYTES = 6 << 20
SAMPLE = 16
#: Phrases of a group: up to about 100 MB in a worker.
GROUP = 1_000_000


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Suffixes of t (symbols below sigma; a suffix that ends is before any longer one) by prefix doubling on packed ranks."""
    n = len(t)
    bits = max(1, int(sigma).bit_length())
    k = max(1, min(62 // bits, n))
    pad = np.zeros(n + k, np.int64)
    pad[:n] = t + 1
    key = pad[:n].copy()
    for j in range(1, k):
        key = (key << bits) | pad[j : n + j]
    sa = np.argsort(key, kind="stable")
    s = key[sa]
    new = np.ones(n, bool)
    new[1:] = s[1:] != s[:-1]
    first = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int64)
    rank[sa] = np.repeat(first, np.diff(np.append(first, n))) + 1  # 0 is the empty suffix
    rank[n] = 0
    size = np.repeat(np.diff(np.append(first, n)), np.diff(np.append(first, n)))
    at = np.flatnonzero(size > 1)
    while len(at):
        own = sa[at]
        key = rank[own] * (n + 2) + rank[np.minimum(own + k, n)]
        o = np.argsort(key, kind="stable")
        own, key = own[o], key[o]
        sa[at] = own
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        rank[own] = np.repeat(at[first], size) + 1
        at = at[np.repeat(size > 1, size)]
        k *= 2
    return sa


class WaveletMatrix:
    """Ranks and symbols of a sequence in bit planes: packed words with the ones before each."""

    def __init__(self, t: np.ndarray, sigma: int):
        self.n, self.bits = len(t), max(1, int(sigma - 1).bit_length())
        self.words, self.ones, self.zeros = [], [], []
        t = t.astype(np.int32)
        for level in range(self.bits - 1, -1, -1):
            bit = ((t >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            w = np.zeros((self.n >> 6) + 1, np.uint64)
            w.view(np.uint8)[: len(packed)] = packed
            ones = np.zeros(len(w) + 1, np.int32)
            np.cumsum(np.bitwise_count(w), out=ones[1:])
            self.words.append(w)
            self.ones.append(ones)
            t = np.concatenate([t[~bit], t[bit]])
            self.zeros.append(self.n - int(ones[-1]))

    def _rank1(self, k: int, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        return self.ones[k][w] + np.bitwise_count(self.words[k][w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def rank(self, c: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
        """How often symbol c[j] stands before position at[j]."""
        low, *at = np.zeros(len(c), np.int64), *at
        for k in range(self.bits):
            one = (c >> (self.bits - 1 - k)) & 1 == 1
            for j, i in enumerate([low, *at]):
                r = self._rank1(k, i)
                i = np.where(one, self.zeros[k] + r, i - r)
                if j:
                    at[j - 1] = i
                else:
                    low = i
        return [i - low for i in at]

    def access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros(len(i), np.int64)
        for k in range(self.bits):
            r = self._rank1(k, i)
            one = ((self.words[k][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)) == 1
            c = (c << 1) | one
            i = np.where(one, self.zeros[k] + r, i - r)
        return c


class FMIndex:
    """FM-index of an integer text; symbol 0 must end it and stand nowhere else."""

    def __init__(self, t: np.ndarray, sigma: int, sample: int = SAMPLE):
        sa = suffix_array(t, sigma)
        self.n, self.sample = len(t), sample
        self.before = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(t, minlength=sigma), out=self.before[1:])
        self.bwt = WaveletMatrix(t[sa - 1], sigma)
        hit = sa % sample == 0
        self.marks = WaveletMatrix(hit, 2)
        self.samples = sa[hit]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range [lo, hi) of every phrase (rows of symbols, padded at the right)."""
        m = len(phrases)
        lo, hi, live = np.zeros(m, np.int64), np.full(m, self.n, np.int64), np.arange(m)
        for j in range(phrases.shape[1]):
            live = live[(lengths[live] > j) & (hi[live] > lo[live])]
            if not len(live):
                break
            c = phrases[live, lengths[live] - 1 - j]
            a, b = self.bwt.rank(c, lo[live], hi[live])
            lo[live], hi[live] = self.before[c] + a, self.before[c] + b
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: last-to-first steps until a sampled position."""
        out, todo, i, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            hit = self.marks.access(i) == 1
            out[todo[hit]] = self.samples[self.marks.rank(np.ones(hit.sum(), np.int64), i[hit])[0]] + steps
            todo, i = todo[~hit], i[~hit]
            if len(i):
                c = self.bwt.access(i)
                i = self.before[c] + self.bwt.rank(c, i)[0]
            steps += 1
        return out


def _phrases(items: DataFrame, text_col: str, n: int) -> DataFrame:
    """Distinct phrases as arrays of word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, buf, off in B.steps(batches, "t"):
            h, _, _, w = B.words(buf, off)
            size = np.diff(w)
            many = np.where(size > 0, np.maximum(size - n + 1, 1), 0)
            length = np.repeat(np.minimum(size, n), many)
            first = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(w[:-1], many)
            end = np.cumsum(length)
            at = np.arange(length.sum()) - np.repeat(end - length, length) + np.repeat(first, length)
            yield pa.record_batch([B.ragged(h[at], np.concatenate([[0], end]))], ["p"])

    return items.select(F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(run, "p array<long>").distinct()


class Phrases:
    """A group of phrases by the numbers of their words, and of each word the phrases whose rarest it is."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.words, number = np.unique(flat, return_inverse=True)
        self.lengths = lengths.astype(np.int32)
        m, width = len(lengths), int(lengths.max(initial=1))
        self.ids = np.full((m, width), -1, np.int32)
        inside = np.arange(width) < lengths[:, None]
        self.ids[inside] = number
        often = np.append(np.bincount(number, minlength=len(self.words)), len(flat) + 1)
        rarest = self.ids[np.arange(m), often[self.ids].argmin(axis=1)] if m else np.zeros(0, np.int64)
        self.order = np.argsort(rarest, kind="stable").astype(np.int32)
        self.first = np.searchsorted(rarest[self.order], np.arange(len(self.words) + 1))

    def within(self, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The phrases whose words are all in a sorted vocabulary, as numbers in it, and their lengths."""
        at = np.searchsorted(self.words, vocab)
        at[at == len(self.words)] = 0
        hit = np.flatnonzero(self.words[at] == vocab) if len(self.words) else np.zeros(0, np.int64)
        symbol = np.full(len(self.words) + 1, -1, np.int64)
        symbol[at[hit]] = hit
        many = self.first[at[hit] + 1] - self.first[at[hit]]
        own = self.order[np.repeat(self.first[at[hit]] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        ids = self.ids[own]
        keep = ((symbol[ids] >= 0) | (ids < 0)).all(axis=1)
        return symbol[ids[keep]], self.lengths[own[keep]].astype(np.int64)


class Shard:
    """The words of some texts; their FM-index is built when a phrase may be there."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        h, self.s, self.e, self.w = B.words(buf, off)
        self.vocab, self.t = np.unique(h, return_inverse=True)
        self.index: FMIndex | None = None

    def occurrences(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and number of words of every occurrence."""
        none = (np.zeros(0, np.int64),) * 3
        if not len(self.vocab):
            return none
        own, lengths = phrases.within(self.vocab)
        if not len(own):
            return none
        counts = np.diff(self.w)
        if self.index is None:  # 1 stands between texts, 0 ends the shard
            seq = np.ones(len(self.t) + len(counts) + 1, np.int64)
            seq[np.arange(len(self.t)) + np.repeat(np.arange(len(counts)), counts)] = self.t + 2
            seq[-1] = 0
            self.index = FMIndex(seq, len(self.vocab) + 2)
        lo, hi = self.index.search(own + 2, lengths)
        many = hi - lo
        at = self.index.locate(np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum()))
        text = np.searchsorted(self.w[:-1] + np.arange(len(counts)), at, "right") - 1
        return text, at - text - self.w[text], np.repeat(lengths, many)

    def spans(self, groups: Iterator[Phrases]) -> tuple[np.ndarray, ...]:
        """Merged spans in order: text, first word, end word, first and end byte, occurrences."""
        found = [self.occurrences(g) for g in groups]
        text, word, many = (np.concatenate([f[k] for f in found]) for k in range(3))
        o = np.lexsort((word, text))
        text, word, stop = text[o], word[o], (word + many)[o]
        if not len(text):
            return (text,) * 6
        reach = np.maximum.accumulate(stop + text * (1 << 40))  # a phrase never crosses texts
        new = np.ones(len(text), bool)
        new[1:] = word[1:] + text[1:] * (1 << 40) > reach[:-1]
        first = np.flatnonzero(new)
        text, start, stop, n = text[first], word[first], np.maximum.reduceat(stop, first), np.diff(np.append(first, len(text)))
        return text, start, stop, self.s[self.w[text] + start], self.e[self.w[text] + stop - 1], n


def _shards(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Consecutive rows until their text exceeds `most` bytes."""
    rows, bufs, offs, total = [], [], [], 0
    for part, buf, off in B.steps(batches, column, most):
        if total and total + len(buf) > most:
            yield rows, np.concatenate(bufs), np.concatenate([*offs, [total]])
            rows, bufs, offs, total = [], [], [], 0
        rows.append(part)
        bufs.append(buf)
        offs.append(off[:-1] + total)
        total += len(buf)
    if rows:
        yield rows, np.concatenate(bufs), np.concatenate([*offs, [total]])


class _Groups:
    """The broadcast groups of phrases; of several, a worker keeps only the one in use."""

    def __init__(self, sent: list):
        self.sent = sent

    def __iter__(self) -> Iterator[Phrases]:
        for b in self.sent:
            yield b.value
            if len(self.sent) > 1 and hasattr(b, "_path"):
                b.__dict__.pop("_value", None)  # read again from the worker's disk when needed


def _groups(spark: SparkSession, benchmark: DataFrame, text_col: str, n: int, group: int) -> _Groups:
    """All phrases of the benchmark, broadcast group by group: the driver, too, holds one at a time."""
    found = cut(_phrases(benchmark, text_col, n))
    parts = max(1, -(-found.count() // group))
    sent = []
    for part in range(parts):
        own = found.where(F.pmod(F.xxhash64("p"), F.lit(parts)) == part).toArrow()["p"].combine_chunks()
        own = pa.concat_arrays(own.chunks) if isinstance(own, pa.ChunkedArray) and own.num_chunks else own
        lengths = own.value_lengths().to_numpy(zero_copy_only=False) if len(own) else np.zeros(0, np.int64)
        flat = own.flatten().to_numpy().view(B.U) if len(own) else np.zeros(0, B.U)
        sent.append(spark.sparkContext.broadcast(Phrases(flat, lengths)))
    return _Groups(sent)


def find_spans(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_text_col: str = "text", n: int = N_WORDS, shard_bytes: int = SHARD_BYTES, group: int = GROUP) -> DataFrame:
    """Removal spans (id, start_word, end_word, char_start, char_end, n_phrases): half-open, from 0, in words and in characters.

    n_phrases counts the phrase occurrences that the span merges.
    """
    groups = _groups(docs.sparkSession, benchmark, item_text_col, n, group)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), *[T.StructField(c, T.LongType()) for c in ("start_word", "end_word", "char_start", "char_end", "n_phrases")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in _shards(batches, "t", shard_bytes):
            text, start, stop, s, e, many = Shard(buf, off).spans(groups)
            if not len(text):
                continue
            ids = pa.chunked_array([r.column(0) for r in rows]).take(pa.array(text)).combine_chunks()
            chars = B.char_index(buf, np.concatenate([off, s, e]))
            base, cs, ce = np.split(chars, [len(off), len(off) + len(s)])
            yield pa.record_batch([ids, *map(pa.array, (start, stop, cs - base[text], ce - base[text], many))], schema.names)

    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    out = src.mapInArrow(run, schema).distinct()
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_text_col: str = "text", n: int = N_WORDS, shard_bytes: int = SHARD_BYTES, group: int = GROUP) -> DataFrame:
    """docs without the passages that benchmark items share, all columns kept in order; a document that keeps no word goes.

    Every row is cut where it is, by its own spans, so no text is shuffled. Rows without spans stay as they are.
    """
    groups = _groups(docs.sparkSession, benchmark, item_text_col, n, group)
    at, schema = docs.columns.index(text_col), docs.schema
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = isinstance(schema[at].dataType, T.StringType)
    read = names[at] if plain else "t"  # a text column is read where it is, not carried twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in _shards(batches, read, shard_bytes):
            shard = Shard(buf, off)
            text, start, stop, s, e, _ = shard.spans(groups)
            table = pa.Table.from_batches(rows)
            table = table if plain else table.drop_columns(["t"])
            rows.clear()
            if len(text):
                new, raw, col = [], buf.tobytes(), table.schema.field(at)
                cut_rows = np.unique(text)
                lost = np.bincount(text, stop - start, len(off) - 1)
                edges = np.searchsorted(text, np.arange(len(off)))
                for k in cut_rows:
                    cuts = slice(edges[k], edges[k + 1])
                    new.append(b"".join(raw[a:b] for a, b in zip([off[k], *e[cuts]], [*s[cuts], off[k + 1]])).decode())
                mask = np.zeros(len(off) - 1, bool)
                mask[cut_rows] = True
                keep = (lost == 0) | (lost < np.diff(shard.w))
                del raw
                whole = pa.concat_arrays(table.column(at).chunks)
                table = table.set_column(at, col, pc.replace_with_mask(whole, pa.array(mask), pa.array(new, col.type))).filter(pa.array(keep))
            del shard
            yield from table.rename_columns(schema.names).to_batches()

    columns = [F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, names)]
    copy = [] if plain else [F.col(f"`{text_col}`").cast("string").alias("t")]
    return docs.select(*columns, *copy).mapInArrow(run, schema)


def remove_spans(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the spans' characters, all columns kept in order; a document that keeps no word goes.

    Documents without spans stay as they are, whatever they hold. Spans of one id that overlap count once.
    """
    per = spans.groupBy(F.col(f"`{id_col}`").alias("__ink_id")).agg(F.sort_array(F.collect_set(F.struct("char_start", "char_end"))).alias("__ink_cuts"))
    text = F.col(f"`{text_col}`")

    @F.arrow_udf("string")
    def left(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for t, ss, es in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist()):
            if t is None or ss is None:
                out.append(t)
                continue
            parts, done = [], 0
            for s, e in zip(ss, es):
                parts.append(t[done:s])
                done = max(done, e)
            out.append("".join([*parts, t[done:]]))
        return pa.array(out, pa.string())

    joined = docs.join(per, docs[f"`{id_col}`"] == per["__ink_id"], "left")
    has = F.col("__ink_cuts").isNotNull()
    done = joined.withColumn("__ink_left", left(F.when(has, text.cast("string")), F.col("__ink_cuts.char_start"), F.col("__ink_cuts.char_end")))
    done = done.where(~has | F.col("__ink_left").rlike(r"[A-Za-z0-9\x{80}-\x{10FFFF}]"))
    return done.select(*[F.when(has, F.col("__ink_left")).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
