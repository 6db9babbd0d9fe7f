"""LM scoring (operator 7): a weighted backoff automaton over the bytes of texts.

Counting: every text is ORDER - 1 start symbols, its UTF-8 bytes and an end symbol; all runs of ORDER symbols of all documents are
counted, and shorter runs follow by dropping their oldest symbols. Probabilities are interpolated absolute discounting,
p(w|h) = max(c(hw) - D, 0) / c(h) + g(h) p(w|h'), where h' is h without its oldest symbol, the empty context falls back to the
uniform distribution, and runs rarer than their order's cutoff count only through g(h) = 1 - sum of the kept (c(hw) - D) / c(h).

Scoring: contexts that have a kept run are states; a kept run hw is an arc from h that weighs log p(w|h) and leads to the longest
suffix of hw that is a state; a failure arc leads from h to h' and weighs log g(h). One pass from left to right carries the
state and adds weights; texts are cut into lanes that take their state from the symbols before them, which is exact as a state
is determined by ORDER - 1 symbols, so a batch's lanes advance together in numpy.

Counts cover all documents and grow with their number of distinct runs, and nothing is pruned but what `cutoffs` say (by default
nothing). An automaton of more than `part_runs` arcs is split by the two newest symbols of the contexts, from which all arcs and
failures of a place go out, but for those of the shortest contexts, which every part has. Each part is broadcast and traversed on
its own, over the places whose two symbols are its own, and a text's sums are added up: the same scores at every size.

Defined results: a NULL text counts and scores as an empty one (its end symbol alone); repeated rows count and score one by one;
NULL ids are kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import bytesops as B
from inkwell.llm.common import Scratch, cut

ORDER = 5
CUTOFFS = (1, 1, 1, 1, 1)
DISCOUNT = 0.75
START, END = 0xFF, 0xFE  # bytes that UTF-8 never has
LANE = 256
#: Arcs of a part, which is broadcast (about 40 bytes an arc), but for the most frequent pair of symbols, which is not split.
PART_RUNS = 4_000_000
#: Distinct runs that a counting task holds before it hands them on.
HELD = 3_000_000
STEP = 1 << 20


def padded(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with start symbols before and an end symbol after, and the offset of each one's first byte."""
    n = len(off) - 1
    first = off[:-1] + (ORDER - 1) + np.arange(n) * ORDER
    out = np.full(len(buf) + n * ORDER, START, np.uint8)
    size = np.diff(off)
    at = np.arange(len(buf)) + np.repeat(first - off[:-1], size)
    out[at] = buf
    out[first + size] = END
    return out, first


def run_keys(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The run that ends at every byte and end symbol, packed with the oldest symbol first, and the texts' offsets in them."""
    sym, first = padded(buf, off)
    key = sym.astype(np.int64)
    for j in range(1, ORDER):
        key[j:] |= sym[: len(sym) - j].astype(np.int64) << (8 * j)
    many = np.diff(off) + 1
    out = np.concatenate([[0], np.cumsum(many)])
    at = np.arange(out[-1]) + np.repeat(first - out[:-1], many)
    return key[at], out


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    o = np.argsort(k, kind="stable")
    k, c = k[o], c[o]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return k[first], np.add.reduceat(c, first) if len(first) else c


def count_runs(docs: DataFrame) -> DataFrame:
    """(key, c) over texts (id, t): each task merges its own counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, fresh = [], [], 0
        for _, buf, off in B.steps(batches, "t", STEP):
            k = np.sort(run_keys(buf, off)[0])
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            keys.append(k[first])
            counts.append(np.diff(np.append(first, len(k))))
            fresh += len(first)
            if fresh > HELD // 2:
                k, c = _merge(keys, counts)
                if len(k) > HELD // 2:
                    yield pa.record_batch([pa.array(k), pa.array(c)], ["key", "c"])
                    keys, counts = [], []
                else:
                    keys, counts = [k], [c]
                fresh = 0
        if keys:
            k, c = _merge(keys, counts)
            yield pa.record_batch([pa.array(k), pa.array(c)], ["key", "c"])

    return docs.mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _mask(order: int) -> int:
    return (1 << 8 * order) - 1


def model_tables(counts: DataFrame, scratch: Scratch, cutoffs: tuple[int, ...] = CUTOFFS, discount: float = DISCOUNT) -> tuple[list[DataFrame], list[DataFrame]]:
    """For each order from 1: kept runs (key, p), and contexts (ctx, g) with what they leave to the shorter context."""
    probs, rest = [], []
    for k in range(1, ORDER + 1):
        own = counts.groupBy(F.col("key").bitwiseAND(F.lit(_mask(k))).alias("key")).agg(F.sum("c").alias("c")).withColumn("ctx", F.shiftright("key", 8))
        kept = F.col("c") >= cutoffs[k - 1]
        context = own.groupBy("ctx").agg(F.sum("c").alias("ch"), F.sum(F.when(kept, F.col("c") - F.lit(discount)).otherwise(F.lit(0.0))).alias("s"), F.max(kept).alias("any"))
        context = scratch.table(context.where("any").select("ctx", "ch", (1.0 - F.col("s") / F.col("ch")).alias("g")))
        alpha = own.where(kept).join(context, "ctx").select("key", F.col("key").bitwiseAND(F.lit(_mask(k - 1))).alias("low"), ((F.col("c") - F.lit(discount)) / F.col("ch")).alias("a"), "g")
        if k == 1:
            p = alpha.select("key", (F.col("a") + F.col("g") / 256.0).alias("p"))
        else:
            p = alpha.join(probs[-1].select(F.col("key").alias("low"), F.col("p").alias("q")), "low").select("key", (F.col("a") + F.col("g") * F.col("q")).alias("p"))
        probs.append(scratch.table(p))
        rest.append(context.select("ctx", "g"))
    return probs, rest


class Automaton:
    """States, failure arcs and a hash table of arcs."""

    def __init__(self, probs: list[tuple[np.ndarray, np.ndarray]], rest: list[tuple[np.ndarray, np.ndarray]]):
        # a state's code: its length above, its symbols below
        code = np.concatenate([c | (k << 40) for k, (c, _) in enumerate(rest)])
        self.log_g = np.log(np.concatenate([g for _, g in rest]))
        o = np.argsort(code)
        self.code, self.log_g = code[o], self.log_g[o]
        length, sym = self.code >> 40, self.code & _mask(5)
        shorter = sym & ((1 << 8 * np.maximum(length - 1, 0)) - 1)
        self.fail = self.state_of(shorter, np.maximum(length - 1, 0))
        src, low, logp, dest = [], [], [], []
        for k, (key, p) in enumerate(probs):
            src.append(self.state_of(key >> 8, np.full(len(key), k)))
            low.append(key & 0xFF)
            logp.append(np.log(p))
            dest.append(self.state_of(key & _mask(ORDER - 1), np.full(len(key), min(k + 1, ORDER - 1))))
        arc = (np.concatenate(src) << 8) | np.concatenate(low)
        self.bits = max(4, int(2 * max(len(arc), 1) - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.weight, self.dest = np.zeros(1 << self.bits), np.zeros(1 << self.bits, np.int32)
        w, d = np.concatenate(logp), np.concatenate(dest)
        todo, slot = np.arange(len(arc)), self._slot(arc)
        while len(todo):  # the first of those that want a free slot takes it, the others look one further
            free = self.keys[slot] == -1
            won, where = np.unique(slot[free], return_index=True)
            who = todo[free][where]
            self.keys[won], self.weight[won], self.dest[won] = arc[who], w[who], d[who]
            left = self.keys[slot] != arc[todo]
            todo, slot = todo[left], (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, arc: np.ndarray) -> np.ndarray:
        return ((arc.astype(B.U) * B.U(0x9E3779B97F4A7C15)) >> B.U(64 - self.bits)).astype(np.int64)

    def state_of(self, symbols: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The longest suffix of the symbols that is a state."""
        out = np.zeros(len(symbols), np.int64)
        todo = np.arange(len(symbols))
        length = length.copy()
        while len(todo):
            m = length[todo]
            want = (symbols[todo] & ((1 << 8 * m) - 1)) | (m << 40)
            at = np.minimum(np.searchsorted(self.code, want), len(self.code) - 1)
            hit = self.code[at] == want
            out[todo[hit]] = at[hit]
            todo = todo[~hit & (m > 0)]
            length[todo] -= 1
        return out

    def score(self, buf: np.ndarray, off: np.ndarray, pairs: tuple[int, int] | None = None) -> np.ndarray:
        """Log-probability of every text, or the part of it from places whose two symbols before are in the range `pairs`."""
        sym, first = padded(buf, off)
        size = np.diff(off) + 1
        if pairs is None:
            whole, of, length = first, np.arange(len(size)), size
        else:
            of = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(of)) + np.repeat(first - (np.cumsum(size) - size), size)
            two = sym[at - 2].astype(np.int64) << 8 | sym[at - 1]
            own = np.flatnonzero((two >= pairs[0]) & (two < pairs[1]))
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1] + 1) | (of[own[1:]] != of[own[:-1]])
            begin = np.flatnonzero(new)
            whole, of, length = at[own[begin]], of[own[begin]], np.diff(np.append(begin, len(own)))
        lanes = -(-length // LANE)
        run = np.repeat(np.arange(len(of)), lanes)
        k = np.arange(len(run)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = whole[run] + k * LANE
        text = of[run]
        many = np.minimum(LANE, length[run] - k * LANE)
        before = np.zeros(len(start), np.int64)
        for j in range(ORDER - 1, 0, -1):
            before = (before << 8) | sym[start - j]
        state = self.state_of(before, np.full(len(start), ORDER - 1))
        o = np.argsort(-many, kind="stable")
        state, at, many = state[o], start[o], many[o]
        total = np.zeros(len(o))
        live = np.searchsorted(-many, -np.arange(LANE), "left")
        top = len(self.keys) - 1
        for t in range(int(many[0]) if len(many) else 0):
            n = live[t]
            c = sym[at[:n] + t].astype(np.int64)
            arc = (state[:n] << 8) | c
            slot = self._slot(arc)
            found = self.keys[slot]
            miss = np.flatnonzero(found != arc)
            own = state[:n]
            while len(miss):  # an empty slot: the arc is not there, so fail; another's slot: look one further
                empty = self.keys[slot[miss]] == -1
                gone = miss[empty]
                s = own[gone]
                total[gone] += self.log_g[s]
                root = s == 0
                total[gone[root]] -= np.log(256.0)  # no arc even from the empty context
                own[gone] = self.fail[s]
                arc[gone] = (own[gone] << 8) | c[gone]
                slot[gone] = self._slot(arc[gone])
                slot[gone[root]] = -1
                on = miss[~empty]
                slot[on] = (slot[on] + 1) & top
                miss = miss[slot[miss] >= 0]
                miss = miss[self.keys[slot[miss]] != arc[miss]]
            lost = slot < 0
            if lost.any():
                ok = np.flatnonzero(~lost)
                total[ok] += self.weight[slot[ok]]
                own[ok] = self.dest[slot[ok]]
                own[lost] = 0
            else:
                total[:n] += self.weight[slot]
                own[:] = self.dest[slot]
        out = np.zeros(len(size))
        np.add.at(out, text[o], total)
        return out


def _bits(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_symbols", F.round("logprob", 4).alias("logprob"), F.round(-F.col("logprob") / F.lit(np.log(2.0).item()) / F.col("n_symbols"), 6).alias("bits_per_symbol"))


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = df.toArrow()
    return t.column(0).to_numpy(), t.column(1).to_numpy()


def _parts(probs: list[DataFrame], part_runs: int) -> list[tuple[int, int] | None]:
    """Ranges of pairs of newest context symbols with about `part_runs` arcs each; None if one automaton has all."""
    many = sum(p.count() for p in probs)
    if many <= part_runs:
        return [None] if many else []
    own = [p.select(F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)).alias("two")) for p in probs[2:]]
    by_pair = own[0]
    for p in own[1:]:
        by_pair = by_pair.unionAll(p)
    pair, n = _arrays(by_pair.groupBy("two").agg(F.count("*")).orderBy("two"))  # 65,536 rows at most
    edges = [int(x) for x in pair[np.flatnonzero(np.diff(np.cumsum(n) // part_runs)) + 1]]
    return list(zip([0, *edges], [*edges, 1 << 16]))


def _automaton(probs: list[DataFrame], rest: list[DataFrame], pairs: tuple[int, int] | None) -> Automaton:
    def own(df: DataFrame, column: str, shift: int) -> DataFrame:
        two = F.shiftright(column, shift).bitwiseAND(F.lit(0xFFFF))
        return df if pairs is None else df.where((two >= pairs[0]) & (two < pairs[1]))

    return Automaton([_arrays(own(p, "key", 8) if k >= 2 else p) for k, p in enumerate(probs)], [_arrays(own(r, "ctx", 0) if k >= 2 else r) for k, r in enumerate(rest)])


def _scored(src: DataFrame, model: Automaton, pairs: tuple[int, int] | None) -> DataFrame:
    """src (t last) with t replaced by n_symbols and logprob; of a part, only the first counts symbols."""
    sent = src.sparkSession.sparkContext.broadcast(model)
    names = [*src.columns[:-1], "n_symbols", "logprob"]
    counts = pairs is None or pairs[0] == 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for part, buf, off in B.steps(batches, "t", STEP):
            n = np.diff(off) + 1
            yield pa.record_batch([*part.columns[:-1], pa.array(n if counts else np.zeros_like(n)), pa.array(own.score(buf, off, pairs))], names)

    kept = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in src.columns[:-1])
    return src.mapInArrow(run, f"{kept}, n_symbols long, logprob double")


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cutoffs: tuple[int, ...] = CUTOFFS, discount: float = DISCOUNT, part_runs: int = PART_RUNS) -> DataFrame:
    """(doc_id, n_symbols, logprob, bits_per_symbol) of every document under the model of all documents."""
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    with Scratch(docs.sparkSession) as scratch:
        counts = scratch.table(count_runs(src))
        probs, rest = model_tables(counts, scratch, cutoffs, discount)
        parts = _parts(probs, part_runs)
        if not parts:
            return docs.sparkSession.createDataFrame([], f"doc_id {kind}, n_symbols long, logprob double, bits_per_symbol double")
        if parts == [None]:
            return _bits(_scored(src, _automaton(probs, rest, None), None))
        # rows are told apart by numbers that are written, so that a retried task finds the same
        keyed = scratch.table(src.select(F.monotonically_increasing_id().alias("row"), "doc_id", "t"))
        sums = [scratch.table(_scored(keyed, _automaton(probs, rest, pairs), pairs)) for pairs in parts]
        every = sums[0]
        for x in sums[1:]:
            every = every.unionByName(x)
        return cut(_bits(every.groupBy("row", "doc_id").agg(F.sum("n_symbols").alias("n_symbols"), F.sum("logprob").alias("logprob"))))
