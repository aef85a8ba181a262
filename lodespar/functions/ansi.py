"""Scalar functions of the ansi dialect as column expressions.

Where Spark's own function means the same it is used as it is; the others are
compositions that add what differs: nulls, bounds, overflow and errors.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS: dict[str, Callable[..., Column]] = {}


def _c(x) -> Column:
    """A column of a name, a column or a literal that is no string."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _l(x) -> Column:
    """A column or a literal."""
    return x if isinstance(x, Column) else F.lit(x)


def fn(f: Callable | None = None, *also: str):
    def add(g: Callable) -> Callable:
        for n in (g.__name__.rstrip("_"), *also):
            FUNCTIONS[n] = g
        return g

    return add(f) if callable(f) else add


#: Names that mean in Spark what they mean here: here -> there.
SAME = {
    **{n: n for n in (
        "array_join", "array_union", "array_distinct", "array_except", "arrays_overlap", "zip_with", "shuffle", "array_sort", "sequence", "crc32", "lpad", "rpad", "year", "quarter", "month",
        "hour", "minute", "second", "current_date", "transform", "filter", "map_filter", "transform_keys", "transform_values", "map_entries", "map_from_entries", "map_keys", "map_values",
        "map_zip_with", "abs", "radians", "degrees", "power", "pow", "exp", "sqrt", "cbrt", "pi", "e", "cos", "cosh", "acos", "sin", "asin", "tan", "tanh", "atan", "atan2", "lower", "upper", "reverse",
        "url_encode", "url_decode", "uuid", "json_array_length", "length", "levenshtein", "slice",
    )},
    "remove_nulls": "array_compact", "all_match": "forall", "any_match": "exists", "zip": "arrays_zip", "repeat": "array_repeat", "bitwise_not": "bitwise_not", "date": "to_date", "week": "weekofyear",
    "week_of_year": "weekofyear", "day": "dayofmonth", "day_of_month": "dayofmonth", "doy": "dayofyear", "day_of_year": "dayofyear", "last_day_of_month": "last_day", "reduce": "aggregate",
    "map_key_exists": "map_contains_key", "negate": "negative", "is_nan": "isnan",
    "levenshtein_distance": "levenshtein", "starts_with": "startswith", "ends_with": "endswith", "to_hex": "hex", "from_hex": "unhex", "codepoint": "ascii", "regexp_split": "split",
    "json_parse": "parse_json", "from_iso8601_date": "to_date", "localtime": "current_time", "bitwise_right_shift_arithmetic": "shiftright", "array_constructor": "array", "map": "map_from_arrays",
    "fail": "raise_error", "arrays_union": "array_union",
}
for _here, _there in SAME.items():
    if hasattr(F, _there):
        FUNCTIONS[_here] = getattr(F, _there)

# ---- arrays


def _any_null(a: Column) -> Column:
    return F.exists(a, lambda x: x.isNull())


@fn
def array_min(a) -> Column:
    """Null if any element is."""
    return F.when(~_any_null(_c(a)), F.array_min(a))


@fn
def array_max(a) -> Column:
    return F.when(~_any_null(_c(a)), F.array_max(a))


@fn
def contains(a, x) -> Column:
    return F.array_contains(a, x)


@fn
def array_has_duplicates(a) -> Column:
    return F.size(_c(a)) > F.size(F.array_distinct(a))


@fn
def array_duplicates(a) -> Column:
    a = _c(a)
    return F.array_sort(F.array_distinct(F.filter(a, lambda x: F.size(F.filter(a, lambda y: y.eqNullSafe(x))) > 1)))


@fn
def array_frequency(a) -> Column:
    a = F.filter(_c(a), lambda x: x.isNotNull())
    kinds = F.array_distinct(a)
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(a, lambda x: x == k))))


@fn
def array_cum_sum(a) -> Column:
    """Sums so far; null from the first null on."""
    a = _c(a)
    return F.transform(a, lambda _, i: F.aggregate(F.slice(a, 1, i + 1), F.element_at(F.slice(a, 1, 1), 1) * 0, lambda s, y: s + y))


@fn
def array_normalize(a, p) -> Column:
    """Divided by the p-norm; as it is for p = 0 or a norm of 0."""
    a, p = _c(a), _l(p)
    norm = F.pow(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.pow(F.abs(x), p)), 1 / p)
    return F.when((p == 0) | (norm == 0), a).otherwise(F.transform(a, lambda x: x / norm))


@fn
def trim_array(a, n) -> Column:
    a, n = _c(a), _l(n)
    bad = F.raise_error(F.lit("size must be between 0 and the array's")).cast("int")
    return F.slice(a, 1, F.when((n < 0) | (n > F.size(a)), bad).otherwise(F.size(a) - n))


@fn
def array_top_n(a, n) -> Column:
    return F.slice(F.sort_array(a, asc=False), 1, n)


@fn
def array_remove(a, x) -> Column:
    """Nulls stay."""
    x = _l(x)
    return F.filter(a, lambda y: ~y.eqNullSafe(x))


@fn
def array_subset(a, at) -> Column:
    a = _c(a)
    return F.transform(F.array_sort(F.array_distinct(F.filter(at, lambda i: (i >= 1) & (i <= F.size(a))))), lambda i: F.element_at(a, i))


@fn
def none_match(a, f) -> Column:
    return ~F.exists(a, f)


@fn
def find_first(a, f, start=1) -> Column:
    return F.get(F.filter(_from(_c(a), start), f), F.lit(0))


def _from(a: Column, start) -> Column:
    start = _l(start)
    forward = F.slice(a, start, F.greatest(F.size(a) - start + 1, F.lit(0)))
    back = F.reverse(F.slice(a, 1, F.greatest(F.size(a) + start + 1, F.lit(0))))
    return F.when(start > 0, forward).otherwise(back) if not isinstance(start, int) else forward


@fn
def find_first_index(a, f) -> Column:
    found = F.filter(F.transform(_c(a), lambda x, i: F.when(f(x), i + 1)), lambda i: i.isNotNull())
    return F.get(found, F.lit(0)).cast("bigint")


@fn
def array_intersect(a, b=None) -> Column:
    """Of two arrays, or of all arrays in an array."""
    if b is not None:
        return F.array_intersect(a, b)
    a = _c(a)
    return F.aggregate(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.array_distinct(F.get(a, F.lit(0))), lambda s, x: F.array_intersect(s, x))


@fn
def array_position(a, x, instance: int | None = None) -> Column:
    """The place of an element, or of its instance-th occurrence (negative: from the end); 0 if there is none."""
    if instance is None:
        return F.array_position(a, x)
    at = F.filter(F.transform(_c(a), lambda y, i: F.when(y == _l(x), i + 1)), lambda i: i.isNotNull())
    return F.coalesce(F.try_element_at(at, F.lit(instance)), F.lit(0)).cast("bigint")


@fn
def array_sort_desc(a, f=None) -> Column:
    """Descending, nulls last; by a function's value if there is one."""
    if f is None:
        return F.concat(F.sort_array(F.array_compact(a), asc=False), F.filter(a, lambda x: x.isNull()))
    return F.transform(F.sort_array(F.transform(a, lambda x: F.struct(f(x).alias("k"), x.alias("x"))), asc=False), lambda s: s["x"])


@fn
def array_max_by(a, f) -> Column:
    return F.array_max(F.transform(a, lambda x: F.struct(f(x).alias("k"), x.alias("x"))))["x"]


@fn
def array_min_by(a, f) -> Column:
    return F.array_min(F.transform(a, lambda x: F.struct(f(x).alias("k"), x.alias("x"))))["x"]


@fn
def flatten(a) -> Column:
    """Null arrays inside count as empty."""
    return F.flatten(F.filter(a, lambda x: x.isNotNull()))


@fn
def array_sum(a) -> Column:
    """Nulls count as 0; the type is that of 0 for integers and of doubles else."""
    a = F.array_compact(a)
    return F.aggregate(a, F.coalesce(F.get(a, F.lit(0)) * 0, F.lit(0)), lambda s, x: s + x)


@fn
def array_average(a) -> Column:
    a = F.array_compact(a)
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


@fn
def combinations(a, n: int) -> Column:
    """All sub-arrays of n elements, in lexicographic order of places, n from 0 to 5."""
    a = _c(a)
    if not 0 <= n <= 5:
        raise ValueError("n must be from 0 to 5")
    places = F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a))).otherwise(F.array().cast("array<int>"))
    longer = lambda s: F.transform(F.filter(places, lambda i: i > F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0))), lambda i: F.concat(s, F.array(i)))
    out = F.array(F.array().cast("array<int>"))
    for _ in range(n):
        out = F.flatten(F.transform(out, longer))
    return F.transform(out, lambda s: F.transform(s, lambda i: F.element_at(a, i)))


@fn
def ngrams(a, n) -> Column:
    """Runs of n elements; the whole array if it is shorter."""
    a, n = _c(a), _l(n)
    return F.when(F.size(a) <= n, F.array(a)).otherwise(F.transform(F.sequence(F.lit(1), F.size(a) - n + 1), lambda i: F.slice(a, i, n)))


@fn
def width_bucket(x, low, high=None, n=None) -> Column:
    """By bounds and a number of buckets, or by an array of rising bounds."""
    if n is not None:
        return F.width_bucket(x, low, high, n)
    return F.size(F.filter(low, lambda b: b <= _c(x))).cast("bigint")


@fn
def cardinality(x) -> Column:
    return F.size(x).cast("bigint")


@fn
def element_at(a, i) -> Column:
    """Null out of bounds."""
    return F.try_element_at(a, _l(i))


@fn
def subscript(a, i) -> Column:
    """An error out of bounds."""
    return F.element_at(a, i)


# ---- maps


@fn
def map_concat(*maps) -> Column:
    """Later maps win."""

    def merge(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)

    return reduce(merge, map(_c, maps))


@fn
def map_subset(m, keys) -> Column:
    return F.map_filter(m, lambda k, _: F.array_contains(keys, k))


@fn
def remap_keys(m, old, new) -> Column:
    """Keys of old become those of new at the same place."""
    old = _c(old)
    return F.transform_keys(m, lambda k, _: F.coalesce(F.get(new, (F.array_position(old, k) - 1).cast("int")), k))


@fn
def map_remove_null_values(m) -> Column:
    return F.map_filter(m, lambda _, v: v.isNotNull())


for _n, _part, _how in (("all_keys_match", F.map_keys, F.forall), ("any_keys_match", F.map_keys, F.exists), ("any_values_match", F.map_values, F.exists)):
    FUNCTIONS[_n] = lambda m, f, p=_part, h=_how: h(p(m), f)
for _n, _part in (("no_keys_match", F.map_keys), ("no_values_match", F.map_values)):
    FUNCTIONS[_n] = lambda m, f, p=_part: ~F.exists(p(m), f)


@fn
def multimap_from_entries(entries) -> Column:
    e = _c(entries)
    keys = F.array_distinct(F.transform(e, lambda x: _field(x, 0)))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(e, lambda x: _field(x, 0) == k), lambda x: _field(x, 1))))


def _field(x: Column, i: int) -> Column:
    """Entries are structs of key and value."""
    return x.getField(("key", "value")[i])


def _top_entries(m, n) -> Column:
    """Entries by descending value, then key; null values last."""
    rows = F.transform(F.map_entries(m), lambda x: F.struct(x["value"].alias("v"), x["key"].alias("k")))
    return F.slice(F.sort_array(rows, asc=False), 1, n)


@fn
def map_top_n(m, n) -> Column:
    return F.map_from_entries(F.transform(_top_entries(m, n), lambda x: F.struct(x["k"], x["v"])))


@fn
def map_top_n_keys(m, n) -> Column:
    return F.slice(F.sort_array(F.map_keys(m), asc=False), 1, n)


@fn
def map_keys_by_top_n_values(m, n) -> Column:
    return F.transform(_top_entries(m, n), lambda x: x["k"])


@fn
def map_top_n_values(m, n) -> Column:
    return F.slice(F.sort_array(F.map_values(m), asc=False), 1, n)


@fn
def map_normalize(m) -> Column:
    m = _c(m)
    total = F.aggregate(F.array_compact(F.map_values(m)), F.lit(0.0), lambda s, x: s + x)
    return F.transform_values(m, lambda _, v: v / total)


# ---- bits


@fn
def bitwise_and(a, b) -> Column:
    return _c(a).cast("bigint").bitwiseAND(_l(b))


@fn
def bitwise_or(a, b) -> Column:
    return _c(a).cast("bigint").bitwiseOR(_l(b))


@fn
def bitwise_xor(a, b) -> Column:
    return _c(a).cast("bigint").bitwiseXOR(_l(b))


@fn
def bit_count(x, bits: int = 64) -> Column:
    """Set bits of the two's complement in so many bits; an error if x doesn't fit."""
    x = _c(x).cast("bigint")
    if bits == 64:
        return F.bit_count(x).cast("bigint")
    low, high = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
    return F.when(x.between(low, high), F.bit_count(x.bitwiseAND((1 << bits) - 1))).otherwise(F.raise_error(F.lit(f"number is no integer of {bits} bits")).cast("int")).cast("bigint")


def _shift(f: str, x, n, beyond) -> Column:
    x, n = _c(x), _l(n)
    call = F.call_function(f, x, n.cast("int"))
    return F.when((n >= 0) & (n < 64), call).otherwise(beyond(x))


@fn
def bitwise_left_shift(x, n) -> Column:
    return _shift("shiftleft", _c(x).cast("bigint"), n, lambda _: F.lit(0).cast("bigint"))


@fn
def bitwise_right_shift(x, n) -> Column:
    return _shift("shiftrightunsigned", _c(x).cast("bigint"), n, lambda _: F.lit(0).cast("bigint"))


@fn(None, "bitwise_right_shift_arithmetic")
def bitwise_arithmetic_shift_right(x, n) -> Column:
    return _shift("shiftright", _c(x).cast("bigint"), n, lambda x: F.when(x < 0, F.lit(-1)).otherwise(F.lit(0)).cast("bigint"))


@fn
def bitwise_logical_shift_right(x, n, bits: int) -> Column:
    x = _c(x).cast("bigint")
    return _shift("shiftrightunsigned", x if bits >= 64 else x.bitwiseAND((1 << bits) - 1), n, lambda _: F.lit(0).cast("bigint"))


@fn
def bitwise_shift_left(x, n, bits: int) -> Column:
    out = _shift("shiftleft", _c(x).cast("bigint"), n, lambda _: F.lit(0).cast("bigint"))
    return out if bits >= 64 else out.bitwiseAND((1 << bits) - 1)


# ---- numbers

for _n, _f in (("plus", lambda a, b: a + b), ("minus", lambda a, b: a - b), ("multiply", lambda a, b: a * b), ("mod", lambda a, b: a % b), ("modulus", lambda a, b: a % b)):
    FUNCTIONS[_n] = lambda a, b, f=_f: f(_c(a), _l(b))
for _n, _f in (("eq", lambda a, b: a == b), ("neq", lambda a, b: a != b), ("lt", lambda a, b: a < b), ("gt", lambda a, b: a > b), ("lte", lambda a, b: a <= b), ("gte", lambda a, b: a >= b), ("distinct_from", lambda a, b: ~a.eqNullSafe(b))):
    FUNCTIONS[_n] = lambda a, b, f=_f: f(_c(a), _l(b))
FUNCTIONS["between"] = lambda x, a, b: _c(x).between(_l(a), _l(b))
FUNCTIONS["in"] = lambda x, *xs: _c(x).isin(*xs)
FUNCTIONS["is_null"] = lambda x: _c(x).isNull()
FUNCTIONS["not"] = lambda x: ~_c(x)
FUNCTIONS["like"] = lambda s, p, escape=None: _c(s).like(p) if escape is None else F.call_function("like", _c(s), F.lit(p), F.lit(escape))
FUNCTIONS["regexp_like"] = lambda s, p: _c(s).rlike(p)
FUNCTIONS["typeof"] = lambda x: F.typeof(x)


@fn(None, "rand", "secure_rand", "secure_random")
def random(low=None, high=None) -> Column:
    """A number from 0 to 1, or a whole one below a bound, or from a first to below a second one."""
    if low is None:
        return F.rand()
    a, b = (F.lit(0), _l(low)) if high is None else (_l(low), _l(high))
    bad = F.raise_error(F.lit("the upper bound must be above the lower one")).cast("bigint")
    return F.when(b > a, a + F.floor(F.rand() * (b - a))).otherwise(bad)


@fn
def sign(x) -> Column:
    """In the type of x."""
    x = _c(x)
    zero = x - x
    return F.when(x > 0, zero + F.lit(1).cast("tinyint")).when(x < 0, zero - F.lit(1).cast("tinyint")).otherwise(x)


@fn
def divide(a, b) -> Column:
    """Integers divide to integers towards 0, an error for 0; else as doubles do, with infinities."""
    return F.call_function("div", _c(a), _l(b))


@fn
def divide_double(a, b) -> Column:
    a, b = _c(a).cast("double"), _l(b).cast("double")
    zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


@fn
def greatest(*xs) -> Column:
    """Null if any is."""
    cs = [_c(x) for x in xs]
    some = cs[0].isNull()
    for c in cs[1:]:
        some = some | c.isNull()
    return F.when(~some, F.greatest(*cs))


@fn
def least(*xs) -> Column:
    cs = [_c(x) for x in xs]
    some = cs[0].isNull()
    for c in cs[1:]:
        some = some | c.isNull()
    return F.when(~some, F.least(*cs))


@fn(None, "ceiling")
def ceil(x, to: str | None = None) -> Column:
    """In the input's type where it is named."""
    return F.ceil(x).cast(to) if to else F.ceil(x)


@fn
def floor(x, to: str | None = None) -> Column:
    return F.floor(x).cast(to) if to else F.floor(x)


@fn
def round_(x, d: int = 0) -> Column:
    """Halves away from 0."""
    return F.round(x, d)


@fn
def truncate(x, d: int | None = None) -> Column:
    """Towards 0, at d decimals."""
    x = _c(x)
    if d is None:
        return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double")
    k = F.lit(float(10**d)) if d >= 0 else F.lit(1.0 / 10**-d)
    return F.when(x >= 0, F.floor(x * k)).otherwise(F.ceil(x * k)) / k


@fn
def clamp(x, low, high) -> Column:
    return F.least(F.greatest(_c(x), _l(low)), _l(high))


def _log(f: Callable, x) -> Column:
    x = _c(x).cast("double")
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(f(x))


FUNCTIONS["ln"] = lambda x: _log(F.log, x)
FUNCTIONS["log2"] = lambda x: _log(F.log2, x)
FUNCTIONS["log10"] = lambda x: _log(F.log10, x)
FUNCTIONS["infinity"] = lambda: F.lit(float("inf"))
FUNCTIONS["nan"] = lambda: F.lit(float("nan"))
FUNCTIONS["is_infinite"] = lambda x: F.abs(_c(x).cast("double")) == float("inf")
FUNCTIONS["is_finite"] = lambda x: ~F.isnan(_c(x).cast("double")) & (F.abs(_c(x).cast("double")) != float("inf"))


@fn
def from_base(s, radix: int) -> Column:
    """A number of a base from 2 to 36; an error for other characters."""
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:radix]
    good = F.lower(_c(s)).rlike(f"^[+-]?[{digits}]+$")
    return F.when(good, F.conv(F.regexp_replace(_c(s), r"^\+", ""), radix, -10).cast("bigint")).when(_c(s).isNotNull(), F.raise_error(F.lit("not a number of that base")).cast("bigint"))


@fn
def to_base(x, radix: int) -> Column:
    x = _c(x)
    return F.concat(F.when(x < 0, "-").otherwise(""), F.lower(F.conv(F.abs(x).cast("string"), 10, radix)))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def _same_size(a: Column, b: Column, x: Column) -> Column:
    return F.when(F.size(a) == F.size(b), x).otherwise(F.raise_error(F.lit("arrays must have the same size")).cast("double"))


@fn
def dot_product(a, b) -> Column:
    a, b = _c(a), _c(b)
    return _same_size(a, b, _dot(a, b))


@fn
def cosine_similarity(a, b) -> Column:
    """Of arrays; null where one has length 0."""
    a, b = _c(a), _c(b)
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return _same_size(a, b, F.when(norm != 0, _dot(a, b) / norm))


@fn
def map_cosine_similarity(a, b) -> Column:
    """Of maps of a name to a number, as sparse vectors."""
    a, b = _c(a), _c(b)
    dot = F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v * v))
    n = norm(a) * norm(b)
    return F.when(n != 0, dot / F.when(n != 0, n))


@fn
def l2_squared(a, b) -> Column:
    a, b = _c(a), _c(b)
    return _same_size(a, b, F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


@fn(None, "parse_presto_data_size")
def parse_data_size(s) -> Column:
    """Text like 2.5kB in bytes, units by 1024, as a decimal."""
    s = _c(s)
    unit = F.create_map(*[F.lit(x) for i, u in enumerate(("B", "kB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")) for x in (u, str(1024**i))])
    n, u = F.regexp_extract(s, r"^\s*(\d+(?:\.\d+)?)\s*([a-zA-Z]+)\s*$", 1), F.regexp_extract(s, r"^\s*(\d+(?:\.\d+)?)\s*([a-zA-Z]+)\s*$", 2)
    return F.floor(n.cast("decimal(18,6)") * F.try_element_at(unit, u).cast("decimal(20,0)")).cast("decimal(38,0)")


# ---- probability, closed forms (the others are in .probability)


@fn
def cauchy_cdf(median, scale, x) -> Column:
    return 0.5 + F.atan((_c(x) - _l(median)) / _l(scale)) / F.pi()


@fn
def inverse_cauchy_cdf(median, scale, p) -> Column:
    return _l(median) + _l(scale) * F.tan(F.pi() * (_c(p) - 0.5))


@fn
def laplace_cdf(mean, scale, x) -> Column:
    d = (_c(x) - _l(mean)) / _l(scale)
    return F.when(d < 0, 0.5 * F.exp(d)).otherwise(1 - 0.5 * F.exp(-d))


@fn
def inverse_laplace_cdf(mean, scale, p) -> Column:
    d = _c(p) - 0.5
    return _l(mean) - _l(scale) * F.signum(d) * F.log(1 - 2 * F.abs(d))


@fn
def weibull_cdf(a, b, x) -> Column:
    x = _c(x)
    return F.when(x <= 0, 0.0).otherwise(1 - F.exp(-F.pow(F.greatest(x, F.lit(0.0)) / _l(b), _l(a))))


@fn
def inverse_weibull_cdf(a, b, p) -> Column:
    return _l(b) * F.pow(-F.log(1 - _c(p)), 1 / _l(a))


def _wilson(s, n, z, sign: int) -> Column:
    s, n, z = _c(s).cast("double"), _c(n).cast("double"), _l(z)
    p = s / n
    return (p + z * z / (2 * n) + sign * z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


FUNCTIONS["wilson_interval_lower"] = lambda s, n, z: _wilson(s, n, z, -1)
FUNCTIONS["wilson_interval_upper"] = lambda s, n, z: _wilson(s, n, z, 1)

# ---- text


@fn
def chr_(n) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(_c(n).cast("bigint")), 8, "0")), "UTF-32")


@fn
def hamming_distance(a, b) -> Column:
    a, b = _c(a), _c(b)
    n = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return F.when(F.length(a) == F.length(b), n).otherwise(F.raise_error(F.lit("texts must have the same length")).cast("bigint"))


#: All white space.
SPACE = r"[\u0009-\u000d\u0020\u0085\u1680\u2000-\u2006\u2008-\u200a\u2028\u2029\u205f\u3000]"


def _trim(s, chars, left: bool, right: bool) -> Column:
    """Of all white space, or of any of the given characters."""
    s = _c(s)
    if chars is not None:
        return (F.btrim if left and right else F.ltrim if left else F.rtrim)(s, _l(chars))
    ends = [p for p, on in ((f"^{SPACE}+", left), (f"{SPACE}+$", right)) if on]
    return F.regexp_replace(s, "|".join(ends).replace("$", r"\z"), "")


FUNCTIONS["trim"] = lambda s, chars=None: _trim(s, chars, True, True)
FUNCTIONS["ltrim"] = lambda s, chars=None: _trim(s, chars, True, False)
FUNCTIONS["rtrim"] = lambda s, chars=None: _trim(s, chars, False, True)


@fn
def trail(s, n) -> Column:
    return F.right(_c(s), _l(n))


@fn(None, "substring")
def substr(s, start, n=None) -> Column:
    """From 1; negative from the end; 0 or beyond the text gives ""."""
    s, start = _c(s), _l(start)
    size = F.length(s)
    at = F.when(start < 0, size + start + 1).otherwise(start)
    take = _l(n) if n is not None else F.lit(2**31 - 1)
    return F.when((at < 1) | (at > size) | (take <= 0), F.lit("")).otherwise(F.substring(s, at, take))


@fn
def split(s, delimiter: str, limit: int | None = None) -> Column:
    return F.split(_c(s), re.escape(delimiter), limit if limit else -1)


@fn
def split_part(s, delimiter: str, i) -> Column:
    """Null past the last part."""
    return F.try_element_at(split(s, delimiter), _l(i))


@fn
def split_to_map(s, entry: str, pair: str) -> Column:
    parts = F.transform(split(s, entry), lambda x: F.split(x, re.escape(pair), 2))
    return F.map_from_arrays(F.transform(parts, lambda p: p[0]), F.transform(parts, lambda p: p[1]))


@fn
def split_to_multimap(s, entry: str, pair: str) -> Column:
    rows = F.transform(split(s, entry), lambda x: F.struct(F.split(x, re.escape(pair), 2)[0].alias("key"), F.split(x, re.escape(pair), 2)[1].alias("value")))
    return multimap_from_entries(rows)


@fn
def replace(s, old: str, new: str = "") -> Column:
    """An empty old puts new before each character and at the end."""
    return F.replace(_c(s), F.lit(old), F.lit(new)) if old else F.concat(F.lit(new), F.array_join(F.split(_c(s), ""), new), F.when(F.length(_c(s)) > 0, F.lit(new)).otherwise(""))


@fn(None, "replacefirst")
def replace_first(s, old: str, new: str) -> Column:
    s = _c(s)
    at = F.instr(s, old)
    return F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), F.lit(new), F.substring(s, at + len(old), F.length(s)))).otherwise(s)


@fn
def strpos(s, sub: str, instance: int = 1) -> Column:
    """The place of the instance-th occurrence, 0 if there is none."""
    s = _c(s)
    at = F.instr(s, sub)
    for _ in range(instance - 1):
        at = F.when(at > 0, F.call_function("locate", F.lit(sub), s, at + 1)).otherwise(0)
    return at.cast("bigint")


@fn
def strrpos(s, sub: str, instance: int = 1) -> Column:
    s = _c(s)
    back = strpos(F.reverse(s), sub[::-1], instance)
    return F.when(back > 0, F.length(s) - back - len(sub) + 2).otherwise(0).cast("bigint")


@fn
def regexp_extract(s, pattern: str, group: int = 0) -> Column:
    """Null where nothing matches."""
    return F.when(_c(s).rlike(pattern), F.regexp_extract(s, pattern, group))


@fn
def regexp_extract_all(s, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(group))


@fn
def regexp_replace(s, pattern: str, new: str = "") -> Column:
    return F.regexp_replace(_c(s), pattern, re.sub(r"\$\{(\w+)\}", r"${\1}", new))


@fn
def to_utf8(s) -> Column:
    return F.encode(_c(s), "UTF-8")


@fn
def from_utf8(b) -> Column:
    """Bytes that are no text become the replacement character."""
    return F.call_function("make_valid_utf8", _c(b).cast("string"))


FUNCTIONS["concat"] = lambda *xs: F.concat(*xs)

# ---- bytes


for _n, _bits in (("sha256", 256), ("sha512", 512)):
    FUNCTIONS[_n] = lambda b, k=_bits: F.unhex(F.sha2(_c(b), k))
FUNCTIONS["md5"] = lambda b: F.unhex(F.md5(_c(b)))
FUNCTIONS["sha1"] = lambda b: F.unhex(F.sha1(_c(b)))
FUNCTIONS["to_base64"] = lambda b: F.regexp_replace(F.base64(_c(b)), r"\s", "")
FUNCTIONS["from_base64"] = lambda s: F.unbase64(_c(s))
FUNCTIONS["to_base64url"] = lambda b: F.translate(F.regexp_replace(F.base64(_c(b)), r"\s", ""), "+/", "-_")
FUNCTIONS["from_base64url"] = lambda s: F.unbase64(F.translate(_c(s), "-_", "+/"))
FUNCTIONS["to_big_endian_64"] = lambda x: F.unhex(F.lpad(F.hex(_c(x).cast("bigint")), 16, "0"))
FUNCTIONS["from_big_endian_64"] = lambda b: F.conv(F.hex(_c(b)), 16, -10).cast("bigint")
FUNCTIONS["to_big_endian_32"] = lambda x: F.unhex(F.lpad(F.hex(_c(x).cast("bigint").bitwiseAND(0xFFFFFFFF)), 8, "0"))


@fn
def from_big_endian_32(b) -> Column:
    x = F.conv(F.hex(_c(b)), 16, 10).cast("bigint")
    return F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x).cast("int")


# ---- dates and times


#: Letters of %-patterns and what stands for them in Spark's patterns.
PERCENT = {"Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h", "i": "mm", "s": "ss", "S": "ss", "f": "SSSSSS", "p": "a", "M": "MMMM", "b": "MMM", "W": "EEEE", "a": "EEE", "j": "DDD", "T": "HH:mm:ss", "r": "hh:mm:ss a", "%": "%"}


def percent_pattern(pattern: str) -> str:
    """A %-pattern of dates as one of Spark's."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "%" and i + 1 < len(pattern):
            i += 1
            out.append(PERCENT[pattern[i]])
        else:
            out.append(f"'{ch}'" if ch.isalpha() else "''" if ch == "'" else ch)
        i += 1
    return "".join(out)


FUNCTIONS["date_format"] = lambda t, p: F.date_format(t, percent_pattern(p))
FUNCTIONS["date_parse"] = lambda s, p: F.to_timestamp(s, percent_pattern(p))
FUNCTIONS["format_datetime"] = lambda t, p: F.date_format(t, p.replace("Y", "y").replace("ZZ", "xxx"))
FUNCTIONS["parse_datetime"] = lambda s, p: F.to_timestamp(s, p.replace("Y", "y").replace("ZZ", "xxx"))
FUNCTIONS["from_iso8601_timestamp"] = lambda s: F.to_timestamp(s)
FUNCTIONS["to_iso8601"] = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
FUNCTIONS["date_trunc"] = lambda unit, t, date=False: F.trunc(_c(t), unit) if date else F.date_trunc(unit, _c(t))  # a date stays a date where it is named as one
FUNCTIONS["dow"] = FUNCTIONS["day_of_week"] = lambda d: F.weekday(d) + 1
FUNCTIONS["yow"] = FUNCTIONS["year_of_week"] = lambda d: F.extract(F.lit("YEAROFWEEK"), _c(d))
FUNCTIONS["millisecond"] = lambda t: F.pmod(F.unix_millis(_c(t).cast("timestamp")), F.lit(1000)).cast("bigint")
FUNCTIONS["to_unixtime"] = lambda t: F.unix_micros(_c(t).cast("timestamp")) / F.lit(1e6)
FUNCTIONS["from_unixtime"] = lambda x: F.timestamp_micros(F.round(_c(x) * 1e6).cast("bigint"))
FUNCTIONS["date_add"] = lambda unit, n, t: F.timestamp_add(unit, _l(n), _c(t))
FUNCTIONS["date_diff"] = lambda unit, a, b: F.timestamp_diff(unit, _c(a), _c(b))
FUNCTIONS["at_timezone"] = lambda t, zone: F.from_utc_timestamp(F.to_utc_timestamp(_c(t), F.current_timezone()), zone)
FUNCTIONS["timezone_hour"] = lambda t, zone: F.floor((F.unix_timestamp(F.from_utc_timestamp(_c(t), zone)) - F.unix_timestamp(_c(t))) / 3600)
FUNCTIONS["timezone_minute"] = lambda t, zone: F.pmod(F.floor((F.unix_timestamp(F.from_utc_timestamp(_c(t), zone)) - F.unix_timestamp(_c(t))) / 60), F.lit(60))
FUNCTIONS["to_milliseconds"] = lambda i: (F.extract(F.lit("DAY"), i) * 86_400_000 + F.extract(F.lit("HOUR"), i) * 3_600_000 + F.extract(F.lit("MINUTE"), i) * 60_000 + F.extract(F.lit("SECOND"), i) * 1000).cast("bigint")


@fn
def parse_duration(s) -> Column:
    """Text like 3.5m as an interval; units ns us ms s m h d."""
    s = _c(s)
    unit = F.create_map(*[F.lit(x) for kv in (("ns", 1e-9), ("us", 1e-6), ("ms", 1e-3), ("s", 1.0), ("m", 60.0), ("h", 3600.0), ("d", 86400.0)) for x in kv])
    p = r"^\s*(\d+(?:\.\d+)?)\s*([a-zA-Z]+)\s*$"
    secs = F.regexp_extract(s, p, 1).cast("double") * F.element_at(unit, F.regexp_extract(s, p, 2))
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round(secs, 6).cast("decimal(18,6)"))


# ---- urls and json

for _n, _part in (("host", "HOST"), ("fragment", "REF"), ("path", "PATH"), ("protocol", "PROTOCOL"), ("query", "QUERY")):
    FUNCTIONS[f"url_extract_{_n}"] = lambda u, p=_part: F.try_parse_url(_c(u), F.lit(p))
FUNCTIONS["url_extract_parameter"] = lambda u, k: F.try_parse_url(_c(u), F.lit("QUERY"), F.lit(k))
FUNCTIONS["url_extract_port"] = lambda u: F.nullif(F.regexp_extract(F.coalesce(F.try_parse_url(_c(u), F.lit("AUTHORITY")), F.lit("")), r":(\d+)$", 1), F.lit("")).try_cast("bigint")


def _scalar(j: Column) -> Column:
    return F.when(~F.trim(j).rlike(r"^[\[{]"), j)


FUNCTIONS["json_extract"] = lambda j, p: F.get_json_object(_c(j), p)
FUNCTIONS["json_extract_scalar"] = lambda j, p: _scalar(F.get_json_object(_c(j), p))
FUNCTIONS["is_json_scalar"] = lambda j: ~F.trim(_c(j)).rlike(r"^[\[{]")
FUNCTIONS["json_format"] = lambda v: F.to_json(v)


@fn
def json_size(j, path: str = "$") -> Column:
    """Elements of an array, keys of an object, 0 for others."""
    x = F.get_json_object(_c(j), path)
    return F.coalesce(F.json_array_length(x), F.size(F.json_object_keys(x)).cast("int"), F.when(x.isNotNull(), 0)).cast("bigint")


def _from_json(j, kind: str) -> Column:
    """Text of JSON as a value of a type; an error where it isn't one."""
    return F.from_json(_c(j), kind, {"mode": "FAILFAST"})


FUNCTIONS["json_string_to_array_cast"] = lambda j, element: _from_json(j, f"array<{element}>")
FUNCTIONS["json_string_to_map_cast"] = lambda j, key, value: _from_json(j, f"map<{key},{value}>")
FUNCTIONS["json_string_to_row_cast"] = lambda j, fields: _from_json(j, f"struct<{fields}>")


for _n in ("array", "map", "row"):
    FUNCTIONS[f"$internal$json_string_to_{_n}_cast"] = FUNCTIONS[f"json_string_to_{_n}_cast"]


@fn
def json_array_get(j, i: int) -> Column:
    """From 0, or from the end if negative."""
    parts = F.from_json(_c(j), "array<string>")
    return F.try_element_at(parts, F.lit(i + 1 if i >= 0 else i))


@fn
def json_array_contains(j, x) -> Column:
    kind = "boolean" if isinstance(x, bool) else "bigint" if isinstance(x, int) else "double" if isinstance(x, float) else "string"
    return F.coalesce(F.array_contains(F.from_json(_c(j), f"array<{kind}>"), F.lit(x)), F.lit(False))


# ---- enums: a dict of names to values stands for the type


@fn
def enum_key(x, members: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(y) for k, v in members.items() for y in (v, k)]), _c(x))


# ---- tiles of web maps: x in the high 32 bits, then 5 bits of zoom, then 27 bits of y


@fn
def bing_tile(x, y, zoom) -> Column:
    x, y, zoom = (_l(v).cast("bigint") for v in (x, y, zoom))
    return F.shiftleft(x, 32).bitwiseOR(F.shiftleft(zoom, 27)).bitwiseOR(y)


def _zoom(t: Column) -> Column:
    return F.shiftright(t, 27).bitwiseAND(31)


def _tx(t: Column) -> Column:
    return F.shiftright(t, 32)


def _ty(t: Column) -> Column:
    return t.bitwiseAND((1 << 27) - 1)


FUNCTIONS["bing_tile_zoom_level"] = lambda t: _zoom(_c(t)).cast("tinyint")
FUNCTIONS["bing_tile_coordinates"] = lambda t: F.struct(_tx(_c(t)).cast("int").alias("x"), _ty(_c(t)).cast("int").alias("y"))


@fn
def bing_tile_quadkey(t) -> Column:
    t = _c(t)
    digit = lambda i: (F.call_function("shiftright", _tx(t), i.cast("int")).bitwiseAND(1) + 2 * F.call_function("shiftright", _ty(t), i.cast("int")).bitwiseAND(1)).cast("string")
    return F.when(_zoom(t) == 0, "").otherwise(F.array_join(F.transform(F.sequence(_zoom(t) - 1, F.lit(0), F.lit(-1)), digit), ""))


@fn
def bing_tile_from_quadkey(q) -> Column:
    q = _c(q)
    digits = F.filter(F.split(q, ""), lambda d: d != "")
    fold = lambda bit: F.aggregate(digits, F.lit(0).cast("bigint"), lambda s, d: s * 2 + F.call_function("shiftright", d.cast("int"), F.lit(bit)).bitwiseAND(1))
    return bing_tile(fold(0), fold(1), F.length(q))


@fn
def bing_tile_parent(t, zoom=None) -> Column:
    t = _c(t)
    up = F.lit(1).cast("bigint") if zoom is None else _zoom(t) - _l(zoom)
    move = lambda v: F.call_function("shiftright", v, up.cast("int"))
    return bing_tile(move(_tx(t)), move(_ty(t)), _zoom(t) - up)


@fn
def bing_tile_children(t) -> Column:
    t = _c(t)
    return F.array(*[bing_tile(_tx(t) * 2 + dx, _ty(t) * 2 + dy, _zoom(t) + 1) for dx, dy in ((0, 0), (1, 0), (0, 1), (1, 1))])


@fn
def bing_tile_at(lat, lon, zoom) -> Column:
    lat, lon, z = _l(lat).cast("double"), _l(lon).cast("double"), _l(zoom)
    size = F.pow(F.lit(2.0), z)
    s = F.sin(F.radians(lat))
    x = F.floor((lon + 180) / 360 * size)
    y = F.floor((0.5 - F.log((1 + s) / (1 - s)) / (4 * F.pi())) * size)
    edge = lambda v: F.least(F.greatest(v, F.lit(0)), (size - 1).cast("bigint"))
    return bing_tile(edge(x), edge(y), z)


@fn
def great_circle_distance(lat1, lon1, lat2, lon2) -> Column:
    """Kilometres on a sphere of radius 6371.01."""
    a, b, c, d = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    delta = b - d
    t1 = F.cos(c) * F.sin(delta)
    t2 = F.cos(a) * F.sin(c) - F.sin(a) * F.cos(c) * F.cos(delta)
    return F.atan2(F.sqrt(t1 * t1 + t2 * t2), F.sin(a) * F.sin(c) + F.cos(a) * F.cos(c) * F.cos(delta)) * 6371.01
