"""Functions on bytes that Spark lacks: keyed hashes, 128-bit hashes, floating-point bytes; and text by the Unicode tables."""

from __future__ import annotations

import hashlib
import hmac
import struct
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, DoubleType, FloatType, StringType

from lodespar.shipping import arrow_column

_ARROW = {BinaryType: pa.binary(), DoubleType: pa.float64(), FloatType: pa.float32(), StringType: pa.string()}


def _column(f: Callable, out: DataType, cast: str | None = None) -> Callable[..., Column]:
    """f by rows of Arrow batches; a null argument gives null."""

    def run(*cols: pa.Array) -> pa.Array:
        return pa.array([None if None in row else f(*row) for row in zip(*[c.to_pylist() for c in cols])], _ARROW[type(out)])

    udf = arrow_column(run, out)

    def call(*xs) -> Column:
        cs = [x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x) for x in xs]
        return udf(*[c.cast(cast) if cast else c for c in cs])

    return call


_M64 = (1 << 64) - 1


def _rotl(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & _M64


def _fmix(k: int) -> int:
    k = ((k ^ (k >> 33)) * 0xFF51AFD7ED558CCD) & _M64
    k = ((k ^ (k >> 33)) * 0xC4CEB9FE1A85EC53) & _M64
    return k ^ (k >> 33)


def murmur3_x64_128(data: bytes, seed: int = 0) -> bytes:
    """MurmurHash3, the 128-bit form for 64-bit machines, as published; little-endian halves."""
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    h1 = h2 = seed
    whole = len(data) // 16 * 16
    for a, b in struct.iter_unpack("<QQ", data[:whole]):
        h1 ^= (_rotl((a * c1) & _M64, 31) * c2) & _M64
        h1 = ((_rotl(h1, 27) + h2) * 5 + 0x52DCE729) & _M64
        h2 ^= (_rotl((b * c2) & _M64, 33) * c1) & _M64
        h2 = ((_rotl(h2, 31) + h1) * 5 + 0x38495AB5) & _M64
    tail = data[whole:].ljust(16, b"\0")
    a, b = struct.unpack("<QQ", tail)
    h2 ^= (_rotl((b * c2) & _M64, 33) * c1) & _M64
    h1 ^= (_rotl((a * c1) & _M64, 31) * c2) & _M64
    h1 ^= len(data)
    h2 ^= len(data)
    h1 = (h1 + h2) & _M64
    h2 = (h2 + h1) & _M64
    h1, h2 = _fmix(h1), _fmix(h2)
    h1 = (h1 + h2) & _M64
    return struct.pack("<QQ", h1, (h2 + h1) & _M64)


def xxhash64(data: bytes, seed: int = 0) -> bytes:
    import xxhash

    return xxhash.xxh64_digest(data, seed & _M64)


FUNCTIONS: dict[str, Callable[..., Column]] = {
    **{f"hmac_{k}": _column(lambda b, key, k=k: hmac.new(key, b, getattr(hashlib, k)).digest(), BinaryType(), "binary") for k in ("md5", "sha1", "sha256", "sha512")},
    "murmur3_x64_128": _column(murmur3_x64_128, BinaryType(), "binary"),
    "xxhash64": _column(xxhash64, BinaryType()),
    "to_ieee754_64": _column(lambda x: struct.pack(">d", x), BinaryType(), "double"),
    "from_ieee754_64": _column(lambda b: struct.unpack(">d", b)[0], DoubleType()),
    "to_ieee754_32": _column(lambda x: struct.pack(">f", x), BinaryType(), "float"),
    "from_ieee754_32": _column(lambda b: struct.unpack(">f", b)[0], FloatType()),
    "normalize": lambda s, form="NFC": _column(lambda t: unicodedata.normalize(form, t), StringType())(s),
}
