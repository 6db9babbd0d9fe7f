"""Packing (operator 5): hierarchical multi-length packing into context windows of several sizes.

Texts become token ids by a public byte-level BPE (its file is a parameter). A document longer than the longest window is cut into
pieces of that size. Every piece is routed to the shortest tier that holds it. From the longest tier to the shortest, a tier's
pieces, longest first, go to the window of the longer tiers with the least sufficient gap, then to the fullest fitting window
of their own tier, then to a new window. The windows of each tier are balanced over groups of `step_windows` (training
steps) by the sum of squared piece lengths, the cost of attention: the costliest window next to the cheapest open group.

The result has one row a window: its tier, its training step, its tokens one piece after another, and for each piece the document,
the number of the piece, where it begins in the document's tokens and where in the window.

Packing runs independently in groups of about `group_tokens` tokens (by a hash of the document's row and the piece), so memory is
bounded however long a document or however often an id is, and the work follows the tokens; a group is large against a window, so
little room is lost at its edges. The tokens move once, to their group.

Defined results: NULL or empty texts have no tokens and no rows; of equal lengths (ties) the lesser id comes first; repeated
rows are packed one by one; NULL ids are packed as a group's first; an empty table gives no rows; other columns are not read. A
long run of white space, over which the encoder's pattern would exhaust its stack, is cut out before as the one piece that the pattern makes of it.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import cut

TIERS = (512, 2048, 8192)
STEP_WINDOWS = 8
GROUP_TOKENS = 8 << 20
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The pattern's white space, in a run too long for it.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")

SCHEMA = "pack_group int, window int, tier int, step int, n_tokens int, doc_ids array<long>, pieces array<int>, piece_starts array<long>, window_starts array<int>, tokens array<int>"


def _encoder(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(encoder, text: str) -> list[int]:
    """The tokens of a text. A run of blanks before a word is one piece but for its last blank, which goes with what follows."""
    out, at = [], 0
    for m in _BLANKS.finditer(text):
        stop = m.end() if m.end() == len(text) else m.end() - 1
        out += encoder.encode_ordinary(text[at : m.start()])
        out += encoder._encode_single_piece(text[m.start() : stop])
        at = stop
    return out + encoder.encode_ordinary(text[at:]) if out else encoder.encode_ordinary(text[at:])


def token_pieces(docs: DataFrame, *, vocabulary: str, longest: int = TIERS[-1], id_col: str = "doc_id", text_col: str = "text", as_bytes: bool = False) -> DataFrame:
    """(row, id, piece, start, n, tokens): every text's tokens in pieces of at most `longest`. `row` tells source rows apart.

    `as_bytes` gives tokens as bytes in place of an array: two a token where the vocabulary has no more than 65,536, else four.
    """
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sent = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary's size is fixed: about 1 MB
    width = np.uint16 if max(ranks.values(), default=0) < 1 << 16 else np.int32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        names = ["row", "id", "piece", "start", "n", "tokens"]
        for b in batches:
            at, piece, start, tokens = [], [], [], []
            held = 0

            def batch(b=b) -> pa.RecordBatch:
                n = np.array([len(t) for t in tokens], np.int64)
                flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
                offs = np.concatenate([[0], np.cumsum(n)])
                if as_bytes:
                    size = np.dtype(width).itemsize
                    made = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((offs * size).astype(np.int32)), pa.py_buffer(flat.astype(width))])
                else:
                    made = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(flat))
                own = pa.array(at, pa.int64())
                return pa.record_batch([b.column(0).take(own), b.column(1).take(own), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n.astype(np.int32)), made], names)

            for k, x in enumerate(b.column(2)):
                own = np.array(encode(encoder, t), np.int32) if (t := x.as_py()) else np.zeros(0, np.int32)
                for j, a in enumerate(range(0, len(own), longest)):
                    at.append(k)
                    piece.append(j)
                    start.append(a)
                    tokens.append(own[a : a + longest])
                held += len(own)
                if held > 1 << 20:
                    yield batch()
                    at, piece, start, tokens, held = [], [], [], [], 0
            yield batch()

    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return src.mapInArrow(run, f"row long, id long, piece int, start long, n int, tokens {'binary' if as_bytes else 'array<int>'}")


class _Windows:
    """Open windows by their gap; the least gap that suffices is found by a bit mask of the gaps in use."""

    def __init__(self):
        self.mask, self.by_gap = 0, {}

    def put(self, gap: int, window: int) -> None:
        if gap > 0:
            self.by_gap.setdefault(gap, []).append(window)
            self.mask |= 1 << gap

    def take(self, need: int) -> tuple[int, int] | None:
        m = self.mask >> need
        if not m:
            return None
        gap = need + (m & -m).bit_length() - 1
        own = self.by_gap[gap]
        window = own.pop()
        if not own:
            del self.by_gap[gap]
            self.mask &= ~(1 << gap)
        return gap, window


def pack(lengths: np.ndarray, tiers: tuple[int, ...] = TIERS, step_windows: int = STEP_WINDOWS) -> list[tuple[int, int, int, int, int, int]]:
    """(piece, tokens, tier, window, place in the window, step) of all pieces of these lengths, none longer than the longest tier."""
    tiers = tuple(sorted(tiers))
    pieces: list[list[tuple[int, int]]] = [[] for _ in tiers]
    for d, n in enumerate(lengths):
        if n:
            pieces[next(i for i, t in enumerate(tiers) if n <= t)].append((-int(n), d))
    out, size, cost = [], [], []
    longer = _Windows()
    of_tier: dict[int, list[int]] = {}
    for t in range(len(tiers) - 1, -1, -1):
        own = _Windows()
        for m, d in sorted(pieces[t]):
            m = -m
            hit, where = longer.take(m), longer
            if hit is None:
                hit, where = own.take(m), own
            if hit is None:
                hit = (tiers[t], len(size))
                size.append(tiers[t])
                cost.append(0)
                of_tier.setdefault(t, []).append(hit[1])
            gap, w = hit
            out.append((d, m, size[w], w, size[w] - gap))
            cost[w] += m * m
            where.put(gap - m, w)
        for gap, windows in own.by_gap.items():
            for w in windows:
                longer.put(gap, w)
    step, base = {}, 0
    for t in sorted(of_tier):
        windows = sorted(of_tier[t], key=lambda w: (-cost[w], w))
        n = -(-len(windows) // step_windows)
        heap = [(0, s, 0) for s in range(n)]
        for w in windows:
            c, s, m = heapq.heappop(heap)
            step[w] = base + s
            if m + 1 < step_windows:
                heapq.heappush(heap, (c + cost[w], s, m + 1))
        base += n
    return [(*row, step[row[3]]) for row in out]


def pack_group(group: int, table: pa.Table, tiers: tuple[int, ...], step_windows: int) -> pa.Table:
    """The windows of one group's pieces (id, piece, start, n, tokens as bytes)."""
    table = table.combine_chunks().sort_by([("piece", "ascending"), ("start", "ascending"), ("n", "ascending"), ("mix", "ascending")])
    nulls = np.asarray(table["id"].is_null())
    ids = table["id"].fill_null(0).to_numpy()
    order = np.lexsort((np.arange(len(ids)), ids, ~nulls))  # stable; NULL ids first
    table = table.take(pa.array(order))
    n = table["n"].to_numpy()
    raw = b"".join(table["tokens"].to_pylist())
    flat = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n.sum() else np.int32).astype(np.int32)
    offs = np.cumsum(n, dtype=np.int64) - n
    rows = np.array(pack(n, tiers, step_windows), np.int64).reshape(-1, 6)
    rows = rows[np.lexsort((rows[:, 4], rows[:, 3]))]  # windows one after the other, pieces by their place
    d, many, tier, window, place, step = rows.T
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(offs[d], many)
    first = np.flatnonzero(np.diff(window, prepend=-1))
    per = np.append(first, len(rows)).astype(np.int32)
    ends = np.append(np.concatenate([[0], np.cumsum(many)])[first], many.sum()).astype(np.int32)
    listed = lambda values, o=per: pa.ListArray.from_arrays(pa.array(o), values)
    own = pa.array(d)
    pick = lambda name: table[name].take(own).combine_chunks()
    return pa.table(
        {
            "pack_group": pa.array(np.full(len(first), group, np.int32)),
            "window": pa.array(window[first].astype(np.int32)),
            "tier": pa.array(tier[first].astype(np.int32)),
            "step": pa.array(step[first].astype(np.int32)),
            "n_tokens": pa.array(np.diff(ends)),
            "doc_ids": listed(pick("id")),
            "pieces": listed(pick("piece")),
            "piece_starts": listed(pick("start")),
            "window_starts": listed(pa.array(place.astype(np.int32))),
            "tokens": listed(pa.array(flat[at]), ends),
        }
    )


def pack_documents(docs: DataFrame, *, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, step_windows: int = STEP_WINDOWS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row a window of every tier, with its tokens, the boundaries of the documents in it, and its step in its packing group."""
    tiers = tuple(sorted(tiers))
    # written once: the rows' numbers must be those that the groups are made of, and the tokens are not made twice
    pieces = cut(token_pieces(docs, vocabulary=vocabulary, longest=tiers[-1], id_col=id_col, text_col=text_col, as_bytes=True))
    groups = max(1, round((pieces.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0) / group_tokens))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pack_group(key[0].as_py(), table, tiers, step_windows)

    keyed = pieces.select(F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).cast("int").alias("g"), "id", "piece", "start", "n", F.xxhash64("tokens").alias("mix"), "tokens")
    return keyed.groupBy("g").applyInArrow(run, SCHEMA)
