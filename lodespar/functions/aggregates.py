"""Aggregate functions of the ansi dialect.

FUNCTIONS give a column for agg(). Aggregates whose state is a table of
values (histogram, map_union_sum, classification curves) have a form on
DataFrames too, which counts before it gathers: use those for large groups, and
in_parts() and reduces() where the values of a group are all gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from lodespar.shipping import arrow_column

from .sketches import construct_digest

FUNCTIONS: dict[str, Callable[..., Column]] = {}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def fn(g: Callable) -> Callable:
    FUNCTIONS[g.__name__.rstrip("_")] = g
    return g


#: Names that mean in Spark what they mean here: here -> there.
SAME = {
    **{n: n for n in ("avg", "bool_and", "bool_or", "every", "count", "count_if", "covar_pop", "covar_samp", "corr", "regr_intercept", "regr_slope", "regr_count", "regr_avgy", "regr_avgx", "regr_sxy", "regr_sxx", "regr_syy", "regr_r2", "skewness", "sum", "stddev", "stddev_pop", "stddev_samp", "variance", "var_pop", "var_samp")},
    "bitwise_or_agg": "bit_or", "bitwise_and_agg": "bit_and", "bitwise_xor_agg": "bit_xor", "approx_set": "hll_sketch_agg", "merge": "hll_union_agg", "numeric_histogram": "histogram_numeric",
    "qdigest_agg": "kll_sketch_agg_double", "tdigest_agg": "kll_sketch_agg_double",
}
for _here, _there in SAME.items():
    if hasattr(F, _there):
        FUNCTIONS[_here] = getattr(F, _there)


@fn
def digest_agg(x, compression: int = 200) -> Column:
    """A digest of centroids, on which the functions of digests work; made by partial sums, so a group of any size takes as many centroids."""
    x = _c(x).cast("double")
    places = F.histogram_numeric(x, F.lit(compression))
    return F.when(F.count(x) > 0, construct_digest(F.transform(places, lambda p: p["x"]), F.transform(places, lambda p: p["y"]), F.min(x), F.max(x)))


@fn
def approx_distinct(x, e: float | None = None) -> Column:
    return F.approx_count_distinct(x, e) if e else F.approx_count_distinct(x)


@fn
def approx_percentile(x, p, accuracy: int = 10_000, weight=None) -> Column:
    """weight: a column of whole weights; a value of weight 0 doesn't count. Of weights the percentile is exact, from the sums by distinct value."""
    if weight is None:
        return F.percentile_approx(x, p, accuracy)
    w = F.when(_c(weight) >= 0, _c(weight)).otherwise(F.raise_error(F.lit("weights must not be negative")).cast("bigint"))
    share = p if isinstance(p, (list, tuple)) else [p]
    at = F.call_function("percentile", _c(x), F.array(*[F.lit(float(q)) for q in share]), w.cast("bigint"))
    return at if isinstance(p, (list, tuple)) else F.get(at, F.lit(0))


@fn
def approx_most_frequent(buckets: int, x, capacity: int = 10_000) -> Column:
    """A map of the most frequent values to their counts."""
    return F.map_from_entries(F.transform(F.call_function("approx_top_k", _c(x), F.lit(buckets), F.lit(capacity)), lambda s: F.struct(s["item"], s["count"])))


@fn
def arbitrary(x) -> Column:
    return F.any_value(x, True)


FUNCTIONS["any_value"] = arbitrary


@fn
def array_agg(x) -> Column:
    """Nulls stay; null for no row."""
    all_ = F.collect_list(F.struct(_c(x).alias("x")))
    return F.when(F.size(all_) > 0, F.transform(all_, lambda s: s["x"]))


@fn
def array_agg_ordered(x, *keys) -> Column:
    """Values in the order of keys."""
    rows = F.array_sort(F.collect_list(F.struct(*[_c(k).alias(f"k{i}") for i, k in enumerate(keys)], _c(x).alias("x"))))
    return F.transform(rows, lambda s: s["x"])


@fn
def set_agg(x) -> Column:
    """Distinct values, null once."""
    null = F.max(_c(x).isNull().cast("int")) == 1
    return F.when(null, F.array_append(F.collect_set(x), F.max(F.when(F.lit(False), _c(x))))).otherwise(F.collect_set(x))


@fn
def set_union(a) -> Column:
    """Equal arrays are held once."""
    return F.array_distinct(F.flatten(F.collect_set(a)))


#: The primes of 64-bit XXHash that a checksum is made of.
PRIME_1, PRIME_2 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F


def _hashes(col: pa.Array) -> np.ndarray:
    """64-bit hashes of the values: one round for numbers, the whole hash for bytes; 0 for null."""
    u = np.uint64
    kind, null = col.type, col.is_null().to_numpy(zero_copy_only=False)

    def rounds(v: np.ndarray) -> np.ndarray:
        x = v.astype(np.int64).view(u) * u(PRIME_2)
        return ((x << u(31)) | (x >> u(33))) * u(PRIME_1)

    if pa.types.is_boolean(kind):
        out = np.where(col.fill_null(False).to_numpy(zero_copy_only=False), u(1231), u(1237))
    elif pa.types.is_floating(kind):
        f = col.fill_null(0).to_numpy(zero_copy_only=False) + 0.0  # -0.0 counts as 0
        f = np.where(np.isnan(f), np.array(np.nan, f.dtype), f)
        out = rounds(f.view(np.int32 if f.dtype == np.float32 else np.int64))
    elif pa.types.is_list(kind):
        sizes = np.where(null, 0, np.asarray(col.value_lengths().fill_null(0))).astype(np.int64)
        inner = _hashes(col.flatten())
        out = np.zeros(len(col), u)
        ends = np.cumsum(sizes)
        for k in range(int(sizes.max(initial=0))):
            on = sizes > k
            out[on] = out[on] * u(31) + inner[(ends - sizes)[on] + k]
    elif pa.types.is_integer(kind) or pa.types.is_date(kind):
        out = rounds((col.cast(pa.int32()) if pa.types.is_date(kind) else col).fill_null(0).to_numpy(zero_copy_only=False))
    elif pa.types.is_timestamp(kind):
        out = rounds(col.cast(pa.timestamp("ms", kind.tz), safe=False).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False))
    else:
        import xxhash

        raw = col.cast(pa.binary()).to_pylist()
        out = np.array([xxhash.xxh64_intdigest(v or b"") for v in raw], u)
    return np.where(null, u(0), out)


def _checksum_parts(col: pa.Array) -> pa.Array:
    x = _hashes(col) * np.uint64(PRIME_1)
    x[col.is_null().to_numpy(zero_copy_only=False)] = np.uint64(PRIME_1)
    return pa.array(x.view(np.int64))


@fn
def checksum(x) -> Column:
    """A hash of the values that doesn't depend on their order, as 8 bytes; null for no row. Halves are summed apart, so no number of rows overflows."""
    part = arrow_column(_checksum_parts, "bigint")(_c(x))
    low = F.sum(part.bitwiseAND(0xFFFFFFFF).cast("decimal(20,0)"))
    high = F.sum(F.shiftrightunsigned(part, 32).cast("decimal(20,0)"))
    carry = F.floor(low / F.lit(1 << 32).cast("decimal(20,0)")).cast("decimal(38,0)")
    half = lambda d: F.lpad(F.hex((d % F.lit(1 << 32).cast("decimal(20,0)")).cast("bigint")), 8, "0")
    return _little(F.concat(half(high + carry), half(low)))


def _little(h: Column) -> Column:
    """Hex digits of 8 bytes, the highest first, as bytes, the lowest first."""
    return F.unhex(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(7, -1, -1)]))


@fn
def entropy(c) -> Column:
    """Of counts, in bits."""
    x = _c(c).cast("double")
    total = F.sum(x)
    logs = F.sum(F.when(x > 0, x * F.log2(x)))
    return F.when(total > 0, F.log2(total) - logs / total).otherwise(0.0)


@fn
def geometric_mean(x) -> Column:
    return F.exp(F.avg(F.log(_c(x).cast("double"))))


@fn
def kurtosis(x) -> Column:
    """Of a sample, less that of a normal distribution; null for fewer than four values."""
    n = F.count(x).cast("double")
    k = F.kurtosis(x) + 3
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k - 3 * (n - 1)))


def _ends(x: Column, n: int, largest: bool) -> Column:
    """The n least or largest values in order, nulls left out; a task holds n of a group, not its values."""
    if n < 1:
        return F.slice(F.sort_array(F.collect_list(x)), 1, n)
    return InternalFunction.collect_top_k(x, n, not largest)


@fn
def min_by(x, y, n: int | None = None) -> Column:
    return F.min_by(x, y) if n is None else F.transform(_ends(F.struct(_c(y).alias("y"), _c(x).alias("x")), n, False), lambda s: s["x"])


@fn
def max_by(x, y, n: int | None = None) -> Column:
    return F.max_by(x, y) if n is None else F.transform(_ends(F.struct(_c(y).alias("y"), _c(x).alias("x")), n, True), lambda s: s["x"])


@fn
def min_(x, n: int | None = None) -> Column:
    return F.min(x) if n is None else _ends(_c(x), n, False)


@fn
def max_(x, n: int | None = None) -> Column:
    return F.max(x) if n is None else _ends(_c(x), n, True)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f and the functions inside it read it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _runs(rows: Column) -> Column:
    """Of structs sorted by their field k: (k, at, n) of each run of equal values that aren't null, at counted from 1."""
    begins = lambda i: F.when(i == 0, True).otherwise(~F.get(rows, i)["k"].eqNullSafe(F.get(rows, i - 1)["k"]))
    heads = F.filter(F.transform(rows, lambda e, i: F.struct(e["k"].alias("k"), (i + 1).alias("at"), begins(i).alias("new"))), lambda s: s["new"] & s["k"].isNotNull())
    # nulls come first, so the last run ends with the array
    return _let(heads, lambda h: F.transform(h, lambda s, i: F.struct(s["k"].alias("k"), s["at"].alias("at"), (F.coalesce(F.get(h, i + 1)["at"], F.size(rows) + 1) - s["at"]).alias("n"))))


def _by_key(entries: Column, value: Callable[[Column, Column], Column]) -> Column:
    """A map from each key of entries (k, v) to a value of all entries and the key's run; sorted once, whatever the number of keys. Entries of a key keep their order."""
    rows = F.sort_array(F.transform(entries, lambda e, i: F.struct(e["k"].alias("k"), i.alias("i"), e["v"].alias("v"))))
    return _let(rows, lambda x: _let(_runs(x), lambda r: F.map_from_arrays(F.transform(r, lambda s: s["k"]), F.transform(r, lambda s: value(x, s)))))


def _pairs(k, v) -> Column:
    return F.collect_list(F.struct(_c(k).alias("k"), _c(v).alias("v")))


def _entries(m) -> Column:
    return F.transform(F.flatten(F.collect_list(F.map_entries(m))), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))


def _first(x: Column, run: Column) -> Column:
    return F.get(x, run["at"] - 1)["v"]


@fn
def map_agg(k, v) -> Column:
    """The first value of each key that isn't null."""
    return _by_key(_pairs(k, v), _first)


@fn
def multimap_agg(k, v) -> Column:
    return _by_key(_pairs(k, v), lambda x, run: F.transform(F.slice(x, run["at"], run["n"]), lambda e: e["v"]))


@fn
def map_union(m) -> Column:
    return _by_key(_entries(m), _first)


@fn
def histogram(x) -> Column:
    """Values to counts; for large groups use histograms()."""
    return _by_key(_pairs(x, F.lit(0)), lambda x, run: run["n"].cast("bigint"))


@fn
def map_union_sum(m) -> Column:
    return _by_key(_entries(m), lambda x, run: F.aggregate(F.slice(x, run["at"], run["n"]), F.lit(0).cast("bigint"), lambda s, e: s + F.coalesce(e["v"], F.lit(0))))


@fn
def reduce_agg(x, initial: Column, f: Callable, g: Callable | None = None) -> Column:
    """Folds the values of a group, which must fit a task; for large groups use reduces()."""
    return F.aggregate(F.collect_list(x), initial, f)


@fn
def sum_data_size_for_stats(x) -> Column:
    return F.sum(F.octet_length(_c(x).cast("string")).cast("bigint"))


@fn
def max_data_size_for_stats(x) -> Column:
    return F.max(F.octet_length(_c(x).cast("string")).cast("bigint"))


def _noise(scale: float, seed: int | None) -> Column:
    return (F.randn(seed) if seed is not None else F.randn()) * F.lit(float(scale))


@fn
def noisy_count_gaussian(x, scale: float, seed: int | None = None) -> Column:
    return F.greatest(F.round(F.count(x) + _noise(scale, seed)), F.lit(0)).cast("bigint")


@fn
def noisy_count_if_gaussian(x, scale: float, seed: int | None = None) -> Column:
    return F.greatest(F.round(F.count_if(_c(x)) + _noise(scale, seed)), F.lit(0)).cast("bigint")


def _clip(x, low, high) -> Column:
    x = _c(x).cast("double")
    return x if low is None else F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


@fn
def noisy_sum_gaussian(x, scale: float, low: float | None = None, high: float | None = None, seed: int | None = None) -> Column:
    return F.sum(_clip(x, low, high)) + _noise(scale, seed)


@fn
def noisy_avg_gaussian(x, scale: float, low: float | None = None, high: float | None = None, seed: int | None = None) -> Column:
    return F.avg(_clip(x, low, high)) + _noise(scale, seed)


# ---- forms on DataFrames: count first, gather the counts


def histograms(df: DataFrame, keys: Sequence[str], x: str, name: str = "histogram") -> DataFrame:
    """Per group a map of values to counts."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(x, "__n"))).alias(name))


def map_union_sums(df: DataFrame, keys: Sequence[str], m: str, name: str = "sums") -> DataFrame:
    sums = df.select(*keys, F.explode(m).alias("__k", "__v")).groupBy(*keys, "__k").agg(F.sum(F.coalesce("__v", F.lit(0))).alias("__v"))
    return sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__k", "__v"))).alias(name))


def multimaps(df: DataFrame, keys: Sequence[str], k: str, v: str, name: str = "multimap") -> DataFrame:
    lists = df.where(F.col(k).isNotNull()).groupBy(*keys, k).agg(F.transform(F.collect_list(F.struct(F.col(v).alias("x"))), lambda s: s["x"]).alias("__v"))
    return lists.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(k, "__v"))).alias(name))


def in_parts(df: DataFrame, keys: Sequence[str], part: dict[str, Column], whole: dict[str, Column]) -> DataFrame:
    """Per group the aggregates whole of those that part gives, under its names, for each 4096 rows as they stand."""
    parts = df.withColumn("__part", F.shiftright(F.monotonically_increasing_id(), 12)).groupBy(*keys, "__part").agg(*[c.alias(n) for n, c in part.items()])
    return parts.groupBy(*keys).agg(*[c.alias(n) for n, c in whole.items()])


def reduces(df: DataFrame, keys: Sequence[str], x: str, initial: Column, f: Callable, g: Callable, name: str = "reduced") -> DataFrame:
    """reduce_agg of groups of any size: f folds 4096 values as they stand from initial, g the results, 4096 at once."""
    now = df.select(*keys, F.col(x).alias("__x"), F.monotonically_increasing_id().alias("__at"))
    for level in range(5):  # ids have 63 bits
        last, fold = level == 4, f if level == 0 else g
        by = [] if last else [F.shiftright("__at", 12).alias("__at")]
        values = F.collect_list("__x")
        first = F.aggregate(values, initial, fold) if level == 0 else F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), fold)
        now = now.groupBy(*keys, *by).agg(first.alias(name if last else "__x"))
    return now


def classification(df: DataFrame, keys: Sequence[str], buckets: int, outcome: str, prediction: str, weight: str | None = None) -> DataFrame:
    """Per group the curves thresholds, precision, recall, fall_out and miss_rate over equal buckets of predictions in [0, 1].

    Weights are summed by bucket first, so a group of any size becomes at most
    that many rows. Buckets without weight give no threshold.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    at = F.least(F.floor(F.col(prediction) * buckets), F.lit(buckets - 1)).cast("int")
    y = F.col(outcome)
    rows = df.where(y.isNotNull() & F.col(prediction).isNotNull()).groupBy(*keys, at.alias("__b")).agg(F.sum(F.when(y, w).otherwise(0.0)).alias("__t"), F.sum(F.when(~y, w).otherwise(0.0)).alias("__f"))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    below = part.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", F.sum("__t").over(part).alias("__tt"), F.sum("__f").over(part).alias("__ff"), F.coalesce(F.sum("__t").over(below), F.lit(0.0)).alias("__tb"), F.coalesce(F.sum("__f").over(below), F.lit(0.0)).alias("__fb"))
    tp, fp = F.col("__tt") - F.col("__tb"), F.col("__ff") - F.col("__fb")
    div = lambda a, b: F.when(b != 0, a / F.when(b != 0, b))
    curve = rows.select(*keys, "__b", F.struct("__b", (F.col("__b") / buckets).alias("thresholds"), div(tp, tp + fp).alias("precision"), div(tp, F.col("__tt")).alias("recall"), div(fp, F.col("__ff")).alias("fall_out"), div(F.col("__tb"), F.col("__tt")).alias("miss_rate")).alias("__s"))
    all_ = F.array_sort(F.collect_list("__s"))
    out = curve.groupBy(*keys).agg(all_.alias("__a"))
    return out.select(*keys, *[F.col("__a").getField(n).alias(n) for n in ("thresholds", "precision", "recall", "fall_out", "miss_rate")])


for _n in ("classification_thresholds", "classification_precision", "classification_recall", "classification_fall_out", "classification_miss_rate"):
    # as a column the curve comes from the group's gathered rows; classification() is the form for large groups
    def _curve(buckets: int, y, x, which: str = _n.split("_", 1)[1]) -> Column:
        rows = F.collect_list(F.struct(_c(y).alias("y"), F.least(F.floor(_c(x) * buckets), F.lit(buckets - 1)).cast("int").alias("b")))
        used = F.array_sort(F.array_distinct(F.transform(rows, lambda r: r["b"])))
        n = lambda cond: F.size(F.filter(rows, cond)).cast("double")
        pos, neg = n(lambda r: r["y"]), n(lambda r: ~r["y"])
        at = {
            "thresholds": lambda b: b / buckets,
            "precision": lambda b: n(lambda r: r["y"] & (r["b"] >= b)) / n(lambda r: r["b"] >= b),
            "recall": lambda b: F.try_divide(n(lambda r: r["y"] & (r["b"] >= b)), pos),
            "fall_out": lambda b: F.try_divide(n(lambda r: ~r["y"] & (r["b"] >= b)), neg),
            "miss_rate": lambda b: F.try_divide(n(lambda r: r["y"] & (r["b"] < b)), pos),
        }[which]
        return F.transform(used, at)

    FUNCTIONS[_n] = _curve
