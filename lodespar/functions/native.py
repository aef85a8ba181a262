"""Expressions of Spark's optimiser that its function library has no name for: TRY, hashes with a seed, bloom filters.

They run inside generated code like all of Spark's own. They need a session in
this process, for they are built in its virtual machine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _jvm():
    sc = SparkContext._active_spark_context
    if sc is None:
        raise RuntimeError("needs an active session")
    return sc._jvm


def _expression(x):
    return _jvm().org.apache.spark.sql.classic.ExpressionUtils.expression(_c(x)._jc)


def _column(e) -> Column:
    return Column(_jvm().org.apache.spark.sql.classic.ExpressionUtils.column(e))


def _all(xs):
    return _jvm().PythonUtils.toSeq([_expression(x) for x in xs])


def _catalyst():
    return _jvm().org.apache.spark.sql.catalyst.expressions


def try_(x) -> Column:
    """The value of any expression; null where it fails."""
    return _column(_catalyst().TryEval(_expression(x)))


def hash_with_seed(seed: int, *xs) -> Column:
    return _column(_catalyst().Murmur3Hash(_all(xs), seed))


def xxhash64_with_seed(seed: int, *xs) -> Column:
    return _column(_catalyst().XxHash64(_all(xs), seed))


def bloom_filter_agg(x, expected: int = 1_000_000, bits: int = 8_388_608) -> Column:
    """The bloom filter of a group's 64-bit hashes, as bytes. Filters of a size merge, so groups are combined before the shuffle."""
    agg = _jvm().org.apache.spark.sql.catalyst.expressions.aggregate.BloomFilterAggregate
    long = lambda n: _expression(F.lit(n).cast("bigint"))
    return _column(agg(_expression(_c(x).cast("bigint")), long(expected), long(bits)).toAggregateExpression())


def might_contain(bloom: bytes | Column, x) -> Column:
    """Whether a filter may hold a 64-bit hash; bloom is a filter's bytes or a scalar subquery."""
    bloom = bloom if isinstance(bloom, Column) else F.lit(bytes(bloom))
    return _column(_catalyst().BloomFilterMightContain(_expression(bloom), _expression(_c(x).cast("bigint"))))


def hive_bucket(n: int, *xs) -> Column:
    """The bucket of n that a table of the older format keeps these keys in."""
    return F.pmod(_column(_catalyst().HiveHash(_all(xs))).bitwiseAND((1 << 31) - 1), F.lit(n))


FUNCTIONS: dict[str, Callable[..., Column]] = {"try": try_, "hash_with_seed": hash_with_seed, "xxhash64_with_seed": xxhash64_with_seed, "bloom_filter_agg": bloom_filter_agg, "might_contain": might_contain, "hive_bucket": hive_bucket}
