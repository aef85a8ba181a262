"""Sketches of sets and of distributions.

Sets are HyperLogLog sketches of Spark. Distributions are Spark's KLL sketches
(made by tdigest_agg and qdigest_agg), or digests of centroids: structs of means
and counts with the least and largest value, made by digest_agg and
construct_digest, on which array functions work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def construct_digest(means, counts, least, most) -> Column:
    """means rise; counts are as many."""
    pairs = F.array_sort(F.zip_with(_c(means), _c(counts), lambda m, n: F.struct(m.cast("double").alias("mean"), n.cast("double").alias("n"))))
    return F.struct(F.transform(pairs, lambda p: p["mean"]).alias("means"), F.transform(pairs, lambda p: p["n"]).alias("counts"), _c(least).cast("double").alias("least"), _c(most).cast("double").alias("most"))


def destructure_digest(d) -> Column:
    d = _c(d)
    return F.struct(d["means"].alias("means"), F.transform(d["counts"], lambda n: n.cast("int")).alias("counts"), d["least"].alias("min"), d["most"].alias("max"), _sum(F.zip_with(d["means"], d["counts"], lambda m, n: m * n)).alias("sum"), _sum(d["counts"]).cast("bigint").alias("count"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def merge_digests(ds) -> Column:
    """All centroids of an array of digests together."""
    ds = F.filter(_c(ds), lambda d: d.isNotNull())
    all_ = lambda f: F.flatten(F.transform(ds, lambda d: d[f]))
    return construct_digest(all_("means"), all_("counts"), F.array_min(F.transform(ds, lambda d: d["least"])), F.array_max(F.transform(ds, lambda d: d["most"])))


def scale_digest(d, k) -> Column:
    d, k = _c(d), _c(k)
    return F.struct(d["means"].alias("means"), F.transform(d["counts"], lambda n: n * k).alias("counts"), d["least"].alias("least"), d["most"].alias("most"))


def _knots(d: Column) -> Column:
    """Points (rank, value): the least at 0, each centroid at the middle of its count, the largest at the total."""
    places = F.transform(d["counts"], lambda n, i: F.struct((_sum(F.slice(d["counts"], 1, i)) + n / 2).alias("r"), F.get(d["means"], i).alias("v")))
    end = lambda r, v: F.array(F.struct(r.alias("r"), v.alias("v")))
    return F.concat(end(F.lit(0.0), d["least"]), places, end(_sum(d["counts"]), d["most"]))


def _between(knots: Column, x: Column, of: str, to: str) -> Column:
    low = F.element_at(F.filter(knots, lambda k: k[of] <= x), -1)
    high = F.get(F.filter(knots, lambda k: k[of] >= x), F.lit(0))
    same = high[of] == low[of]
    return F.when(same, low[to]).otherwise(low[to] + (high[to] - low[to]) * (x - low[of]) / F.when(~same, high[of] - low[of]))


def value_at_quantile_digest(d, q) -> Column:
    d = _c(d)
    return _between(_knots(d), _c(q) * _sum(d["counts"]), "r", "v")


def quantile_at_value_digest(d, v) -> Column:
    d, v = _c(d), _c(v).cast("double")
    inside = _between(_knots(d), v, "v", "r") / _sum(d["counts"])
    return F.when(v < d["least"], 0.0).when(v > d["most"], 1.0).otherwise(inside)


def trimmed_mean(d, low, high) -> Column:
    """Mean of what lies between two quantiles, centroids cut in proportion."""
    d = _c(d)
    total = _sum(d["counts"])
    a, b = _c(low) * total, _c(high) * total
    part = F.transform(d["counts"], lambda n, i: F.greatest(F.lit(0.0), F.least(_sum(F.slice(d["counts"], 1, i + 1)), b) - F.greatest(_sum(F.slice(d["counts"], 1, i)), a)))
    weight = _sum(part)
    return F.when(weight > 0, _sum(F.zip_with(part, d["means"], lambda w, m: w * m)) / F.when(weight > 0, weight))


def _many(f: Callable) -> Callable:
    return lambda s, xs: F.transform(_c(xs), lambda x: f(s, x))


def empty_approx_set() -> Column:
    """A sketch of no value, as an aggregate."""
    return F.hll_sketch_agg(F.lit(None).cast("bigint"))


def merge_hll(sketches) -> Column:
    a = F.array_compact(_c(sketches))
    return F.when(F.size(a) > 0, F.aggregate(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.get(a, F.lit(0)), lambda x, y: F.hll_union(x, y)))


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "construct_tdigest": construct_digest, "destructure_tdigest": destructure_digest, "merge_tdigest": merge_digests, "scale_tdigest": scale_digest, "scale_qdigest": scale_digest, "trimmed_mean": trimmed_mean,
    "value_at_quantile_digest": value_at_quantile_digest, "quantile_at_value_digest": quantile_at_value_digest, "values_at_quantiles_digest": _many(value_at_quantile_digest), "quantiles_at_values_digest": _many(quantile_at_value_digest),
    "value_at_quantile": lambda s, q: F.kll_sketch_get_quantile_double(_c(s), _c(q)), "values_at_quantiles": lambda s, qs: F.kll_sketch_get_quantile_double(_c(s), _c(qs)), "quantile_at_value": lambda s, v: F.kll_sketch_get_rank_double(_c(s), _c(v)),
    "quantiles_at_values": lambda s, vs: F.kll_sketch_get_rank_double(_c(s), _c(vs)), "cardinality_hll": lambda s: F.hll_sketch_estimate(_c(s)), "empty_approx_set": empty_approx_set, "merge_hll": merge_hll,
}
