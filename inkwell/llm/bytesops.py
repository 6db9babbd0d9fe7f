"""Vectorised work on UTF-8 bytes: one numpy pass over many texts instead of a Python loop over words.

A word is a maximal run of ASCII letters, digits and non-ASCII code points, folded to lower case. Folding keeps the number of
bytes (it covers the code points below U+0800 whose lower case is as long), so offsets in the folded bytes hold in the text.
NULL texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that one vectorised step works on; one longer text is a step of its own.
STEP_BYTES = 384 << 10

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LOW = np.arange(0x800, dtype=np.uint16)
for _c in range(0x80, 0x800):
    if len(_l := chr(_c).lower()) == 1 and 0x80 <= ord(_l) < 0x800:
        _LOW[_c] = ord(_l)

_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_POW = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of the hash's base and of its inverse, modulo 2**64."""
    if len(_POW[0]) <= n:
        for k, b in enumerate((_BASE, _INV)):
            p = np.full(max(n + n // 2 + 1, STEP_BYTES + 1), b, U)
            p[0] = 1
            _POW[k] = np.cumprod(p, dtype=U)
    return _POW[0], _POW[1]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + U((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column one after another, and the rows' offsets in them."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32, len(col) + 1 + col.offset)[col.offset :].astype(np.int64) if offs else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def steps(batches: Iterator[pa.RecordBatch], column: str, most: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about `most` bytes of text each (a single longer text makes a slice), as (rows, bytes, offsets)."""
    for batch in batches:
        buf, off = utf8(batch.column(batch.schema.get_field_index(column)))
        a, n = 0, batch.num_rows
        while a < n:
            b = min(n, max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1))
            yield batch.slice(a, b - a), buf[off[a] : off[b]], off[a : b + 1] - off[a]
            a = b


def fold(buf: np.ndarray) -> np.ndarray:
    """Lower case, byte for byte."""
    out = _FOLD[buf]
    lead = np.flatnonzero((buf >= 0xC3) & (buf <= 0xDF))
    lead = lead[lead + 1 < len(buf)]
    if len(lead):
        low = _LOW[((buf[lead] & 0x1F).astype(np.uint16) << 6) | (buf[lead + 1] & 0x3F)]
        out[lead] = 0xC0 | (low >> 6)
        out[lead + 1] = 0x80 | (low & 0x3F)
    return out


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the offsets of the texts in the list of words."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = _WORD[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside
    stop = np.empty(n, bool)
    stop[:-1] = ~inside[1:] | edge[1:-1]
    stop[-1] = True
    s, e = np.flatnonzero(starts), np.flatnonzero(ends & stop) + 1
    return s, e, np.searchsorted(s, off)


def span_hash(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span [s, e): a polynomial over prefix sums, then a finaliser."""
    n = len(buf)
    p, inv = _powers(n)
    c = np.zeros(n + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * p[:n], out=c[1:])
    return mix((c[e] - c[s]) * inv[s])


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each folded word, and the texts' offsets in the list of words."""
    parts, a, n = [], 0, len(off) - 1
    while a < n:  # in steps that stay in the cache
        b = min(n, max(a + 1, int(np.searchsorted(off, off[a] + STEP_BYTES, "right")) - 1))
        low = fold(buf[off[a] : off[b]])
        s, e, w = word_bounds(low, off[a : b + 1] - off[a])
        parts.append((span_hash(low, s, e), s + off[a], e + off[a], w[1:]))
        a = b
    if len(parts) == 1:
        h, s, e, w = parts[0]
        return h, s, e, np.concatenate([[0], w])
    if not parts:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    h, s, e = (np.concatenate([p[k] for p in parts]) for k in range(3))
    before = np.cumsum([0, *(len(p[0]) for p in parts)])
    return h, s, e, np.concatenate([[0], *(p[3] + b for p, b in zip(parts, before))])


def ragged(values: np.ndarray, off: np.ndarray) -> pa.ListArray:
    """list<int64> from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values.view(np.int64) if values.dtype == U else values))


def char_index(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points before the byte positions `at` (ascending or not)."""
    c = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=c[1:])
    return c[at]
