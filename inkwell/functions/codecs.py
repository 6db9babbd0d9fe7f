"""Codecs: variable-length integers, deltas, checksums and skip entries.

Parquet encodes the engine's tables; these serve exchange with byte formats, and as array Columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.constants import SKIP_INTERVAL


def _encode(value: int, most: int) -> bytes:
    if not 0 <= value <= most:
        raise ValueError(f"{value} is not in 0..{most}")
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def encode_varint(value: int) -> bytes:
    return _encode(value, 2**31 - 1)


def encode_varlong(value: int) -> bytes:
    return _encode(value, 2**63 - 1)


def _decode(data: bytes, at: int, most: int) -> tuple[int, int]:
    value = shift = 0
    for k in range(at, len(data)):
        value |= (data[k] & 0x7F) << shift
        if data[k] < 0x80:
            if value > most:
                raise ValueError("the number is too large")
            return value, k + 1
        shift += 7
        if shift > 63:
            raise ValueError("the number is too long")
    raise ValueError("the data end within a number")


def decode_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """The number at a place, and the place after it."""
    return _decode(data, at, 2**31 - 1)


def decode_varlong(data: bytes, at: int = 0) -> tuple[int, int]:
    return _decode(data, at, 2**63 - 1)


def varint_size(value: int) -> int:
    if value < 0:
        raise ValueError("negative")
    return max(1, -(-value.bit_length() // 7))


def delta_encode(values: Sequence[int]) -> list[int]:
    """The first value, then differences; values must not decrease."""
    if any(b < a for a, b in zip(values, values[1:])):
        raise ValueError("values decrease")
    return [v - (values[k - 1] if k else 0) for k, v in enumerate(values)]


def delta_decode(deltas: Iterable[int]) -> list[int]:
    out, total = [], 0
    for d in deltas:
        total += d
        out.append(total)
    return out


def encode_deltas(values: Sequence[int]) -> bytes:
    """Number of values, then their deltas, as varints."""
    return b"".join(map(encode_varint, [len(values), *delta_encode(values)]))


def decode_deltas(data: bytes) -> list[int]:
    n, at = decode_varint(data)
    out = []
    for _ in range(n):
        d, at = decode_varint(data, at)
        out.append(d)
    return delta_decode(out)


def deltas_size(values: Sequence[int]) -> int:
    return sum(map(varint_size, [len(values), *delta_encode(values)]))


def with_crc(data: bytes) -> bytes:
    return data + zlib.crc32(data).to_bytes(4, "big")


def check_crc(data: bytes) -> bytes:
    body = data[:-4]
    if len(data) < 4 or zlib.crc32(body) != int.from_bytes(data[-4:], "big"):
        raise ValueError("checksum mismatch")
    return body


def skip_entries(doc_ids: Sequence[int], every: int = SKIP_INTERVAL) -> list[tuple[int, int]]:
    """(document, index) of every `every`-th posting but the first."""
    return [(doc_ids[k], k) for k in range(every, len(doc_ids), every)]


def delta_array(values: Column) -> Column:
    """Deltas of an array column."""
    return F.transform(values, lambda v, i: v - F.when(i > 0, F.element_at(values, F.greatest(i, F.lit(1)))).otherwise(F.lit(0)))


def undelta_array(deltas: Column) -> Column:
    """Running sums of an array column, in time in proportion to its length; NULL stays."""

    @F.arrow_udf("array<long>")
    def run(col: pa.Array) -> pa.Array:
        many = col.value_lengths().fill_null(0).to_numpy()
        ends = np.concatenate([[0], np.cumsum(many)])
        sums = np.concatenate([[0], np.cumsum(col.flatten().to_numpy(zero_copy_only=False).astype(np.int64))])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(sums[1:] - np.repeat(sums[ends[:-1]], many)), mask=col.is_null())

    return run(deltas)


def varint_size_column(v: Column) -> Column:
    out = F.lit(9)
    for k in range(8, 0, -1):
        out = F.when(v < F.lit(1 << 7 * k), F.lit(k)).otherwise(out)
    return out
