"""Addresses and prefixes of the internet, as text; arithmetic by the standard library on Arrow batches."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, StringType

from lodespar.shipping import arrow_column


def _net(p: str):
    return ipaddress.ip_network(p, strict=False)


def ip_prefix(address: str, bits: int) -> str:
    a = ipaddress.ip_address(address)
    if not 0 <= bits <= a.max_prefixlen:
        raise ValueError("bits are out of range")
    return str(ipaddress.ip_network(f"{a}/{bits}", strict=False))


def ip_subnet_min(p: str) -> str:
    return str(_net(p).network_address)


def ip_subnet_max(p: str) -> str:
    return str(_net(p).broadcast_address)


def ip_subnet_range(p: str) -> list[str]:
    return [ip_subnet_min(p), ip_subnet_max(p)]


def is_subnet_of(p: str, other: str) -> bool:
    """other: an address or a prefix."""
    a, b = _net(p), _net(other)
    return a.version == b.version and b.subnet_of(a)


def ip_prefix_collapse(ps: list[str | None]) -> list[str]:
    """The fewest prefixes that cover the same addresses; all must be of one version."""
    nets = [_net(p) for p in ps if p is not None]
    if len(nets) != len(ps) or len({n.version for n in nets}) > 1:
        raise ValueError("prefixes must be given and of one version")
    return [str(n) for n in ipaddress.collapse_addresses(nets)]


def ip_prefix_subnets(p: str, length: int) -> list[str]:
    n = _net(p)
    return [] if length < n.prefixlen else [str(s) for s in n.subnets(new_prefix=length)]


def is_private_ip(address: str) -> bool:
    return ipaddress.ip_address(address).is_private


_KINDS = {ip_prefix: StringType(), ip_subnet_min: StringType(), ip_subnet_max: StringType(), ip_subnet_range: ArrayType(StringType()), is_subnet_of: BooleanType(), ip_prefix_collapse: ArrayType(StringType()), ip_prefix_subnets: ArrayType(StringType()), is_private_ip: BooleanType()}


def _column(f: Callable, out: DataType) -> Callable[..., Column]:
    kind = pa.bool_() if isinstance(out, BooleanType) else pa.list_(pa.string()) if isinstance(out, ArrayType) else pa.string()

    def run(*cols: pa.Array) -> pa.Array:
        return pa.array([None if None in row else f(*row) for row in zip(*[c.to_pylist() for c in cols])], kind)

    udf = arrow_column(run, out)
    return lambda *xs: udf(*[x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x) for x in xs])


FUNCTIONS: dict[str, Callable[..., Column]] = {f.__name__: _column(f, t) for f, t in _KINDS.items()}
