"""Transforms of partitioned tables: buckets by a 32-bit hash of published form, and values cut to a width."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodespar.shipping import arrow_column

_C1, _C2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def murmur3_32(values: list[bytes], seed: int = 0) -> np.ndarray:
    """MurmurHash3, the 32-bit form, of many byte strings at once, word by word."""
    size = np.fromiter(map(len, values), np.int64, len(values))
    words = (size + 3) // 4
    first = np.cumsum(words) - words
    raw = np.frombuffer(b"".join(v + b"\0" * (-len(v) % 4) for v in values), "<u4")
    order = np.argsort(-words, kind="stable")
    h = np.full(len(values), seed, np.uint32)
    live = len(order)
    for k in range(int(words.max(initial=0))):
        live = int(np.searchsorted(-words[order], -k, "left"))
        at = order[:live]
        x = _rotl(raw[first[at] + k] * _C1, 15) * _C2
        whole = size[at] >= 4 * (k + 1)
        y = h[at] ^ x
        h[at] = np.where(whole, _rotl(y, 13) * np.uint32(5) + np.uint32(0xE6546B64), y)
    h ^= size.astype(np.uint32)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def _bytes(col: pa.Array) -> list[bytes]:
    """Whole numbers, dates and times as 8 bytes, decimals as their unscaled value in as few bytes as hold it, text as UTF-8."""
    kind = col.type
    if pa.types.is_decimal(kind):
        out = []
        for v in col.to_pylist():
            n = int((v or 0).scaleb(kind.scale)) if v is not None else 0
            out.append(n.to_bytes((n + (n < 0)).bit_length() // 8 + 1, "big", signed=True))
        return out
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return [(v or "").encode() for v in col.to_pylist()]
    if pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
        return [v or b"" for v in col.to_pylist()]
    if pa.types.is_date(kind):
        col = col.cast(pa.int32())
    if pa.types.is_timestamp(kind):
        col = col.cast(pa.timestamp("us", kind.tz)).cast(pa.int64())
    raw = col.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
    return [raw[i : i + 8] for i in range(0, len(raw), 8)]


def bucket(n: int, x) -> Column:
    """The bucket of n by the positive part of the hash of a whole number, decimal, date, time, text or bytes; null for null."""

    def run(col: pa.Array) -> pa.Array:
        h = murmur3_32(_bytes(col)) & np.uint32(0x7FFFFFFF)
        return pa.array((h % np.uint32(n)).astype(np.int32), mask=col.is_null().to_numpy(zero_copy_only=False))

    return arrow_column(run, "int")(_c(x))


def truncate(width: int, x, kind: str = "text") -> Column:
    """kind text or bytes: the first width characters or bytes; number: down to a multiple of width, of the unscaled value for a decimal of the scale that kind names, as in decimal(2)."""
    x = _c(x)
    if kind in ("text", "bytes"):
        return F.substring(x, 1, width)
    step = F.lit(width) if kind == "number" else F.lit(width).cast("decimal(18,0)") / F.lit(10 ** int(kind[8:-1])).cast("decimal(19,0)")
    return x - F.pmod(x, step)


FUNCTIONS: dict[str, Callable[..., Column]] = {"bucket": bucket, "truncate": truncate}
