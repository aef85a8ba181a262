"""Functions of the spark dialect: Spark's own, by the names under which plans call them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS: dict[str, Callable[..., Column]] = {}

#: Names that pyspark.sql.functions has as they are.
NAMES = """
transform aggregate array array_contains array_distinct array_except array_intersect array_position arrays_zip exists filter forall zip_with concat array_join array_min array_max array_remove array_prepend array_union
array_compact array_sort sort_array array_repeat flatten array_insert get shuffle array_append crc32 hash xxhash64 md5 sha1 sha2 bitwise_not bit_count bit_get shiftleft shiftright isnull isnotnull least greatest year
to_utc_timestamp from_utc_timestamp unix_date unix_seconds unix_timestamp to_unix_timestamp from_unixtime make_date datediff last_day add_months date_add date_format date_from_unix_date date_sub day dayofmonth dayofyear
dayofweek weekday quarter month next_day hour minute second make_ym_interval make_timestamp unix_micros timestamp_micros unix_millis timestamp_millis timestamp_seconds date_trunc trunc months_between get_json_object
json_object_keys json_array_length to_json from_json map_from_arrays map_filter map_entries map_keys map_values map_zip_with map_concat element_at size abs acos asin acosh asinh atan atanh sec csc sinh cos cosh cot degrees
atan2 log1p bin hex exp expm1 pmod power rint round unhex ceil floor hypot log2 log10 log sqrt cbrt width_bucket rand random sign isnan factorial monotonically_increasing_id raise_error spark_partition_id uuid regexp_extract
regexp_extract_all regexp_replace rlike like reverse startswith endswith contains locate trim ltrim rtrim translate conv replace find_in_set ascii lpad rpad substring overlay str_to_map left bit_length instr length
substring_index levenshtein repeat soundex split mask upper lower base64 unbase64 initcap url_encode url_decode slice bit_xor skewness kurtosis collect_list collect_set covar_samp corr first last min max max_by min_by mode avg
sum stddev stddev_samp variance var_samp count count_if row_number rank dense_rank percent_rank cume_dist ntile nth_value first_value last_value lag lead
""".split()
for _n in NAMES:
    if hasattr(F, _n):
        FUNCTIONS[_n] = getattr(F, _n)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _op(f: Callable) -> Callable:
    return lambda a, b: f(_c(a), _c(b))


FUNCTIONS |= {
    "chr": lambda n: F.char(_c(n)), "array_sort_desc": lambda a: F.sort_array(a, asc=False), "luhn_check": lambda s: F.call_function("luhn_check", _c(s)), "map": lambda *kv: F.create_map(*kv),
    "week_of_year": F.weekofyear, "year_of_week": lambda d: F.extract(F.lit("YEAROFWEEK"), _c(d)), "get_timestamp": lambda s, f: F.to_timestamp(_c(s), f), "unaryminus": F.negative,
    "timestampdiff": lambda u, a, b: F.timestamp_diff(u, _c(a), _c(b)), "timestampadd": lambda u, n, t: F.timestamp_add(u, _c(n), _c(t)), "not": lambda x: ~_c(x),
    "bitwise_and": _op(lambda a, b: a.bitwiseAND(b)), "bitwise_or": _op(lambda a, b: a.bitwiseOR(b)), "bitwise_xor": _op(lambda a, b: a.bitwiseXOR(b)),
    "equalto": _op(lambda a, b: a == b), "notequalto": _op(lambda a, b: a != b), "equalnullsafe": _op(lambda a, b: a.eqNullSafe(b)), "lessthan": _op(lambda a, b: a < b), "greaterthan": _op(lambda a, b: a > b),
    "lessthanorequal": _op(lambda a, b: a <= b), "greaterthanorequal": _op(lambda a, b: a >= b), "add": _op(lambda a, b: a + b), "subtract": _op(lambda a, b: a - b), "multiply": _op(lambda a, b: a * b),
    "divide": _op(lambda a, b: a / b), "remainder": _op(lambda a, b: a % b), "checked_add": _op(lambda a, b: a + b), "checked_subtract": _op(lambda a, b: a - b), "checked_multiply": _op(lambda a, b: a * b),
    "checked_divide": _op(lambda a, b: a / b), "checked_div": lambda a, b: F.call_function("div", _c(a), _c(b)), "between": lambda x, a, b: _c(x).between(_c(a), _c(b)), "in": lambda x, *xs: _c(x).isin(*xs),
    "get_struct_field": lambda s, f: _c(s).getField(f), "get_array_struct_fields": lambda a, f: F.transform(a, lambda s: s.getField(f)), "cast": lambda x, t: _c(x).cast(t), "try_cast": lambda x, t: _c(x).try_cast(t),
    "empty2null": lambda s: F.nullif(_c(s), F.lit("")), "decimal_round": F.round, "make_decimal": lambda x, p, s: (_c(x).cast("decimal(38,0)") / F.lit(10**s).cast("decimal(20,0)")).cast(f"decimal({p},{s})"),
    "unscaled_value": lambda x, s: (_c(x) * F.lit(10**s).cast("decimal(20,0)")).cast("bigint"), "first_ignore_null": lambda x: F.first(x, ignorenulls=True), "last_ignore_null": lambda x: F.last(x, ignorenulls=True),
    "at_least_n_non_nulls": lambda n, *xs: sum((F.when(_c(x).isNotNull() & ~F.coalesce(F.isnan(_c(x).try_cast("double")), F.lit(False)), 1).otherwise(0) for x in xs), F.lit(0)) >= n,
    "concat_ws": F.concat_ws, "coalesce": F.coalesce, "if": lambda c, a, b: F.when(_c(c), _c(a)).otherwise(_c(b)), "nullif": lambda a, b: F.nullif(_c(a), _c(b)),
}
for _n, _of in (("decimal_greaterthan", "greaterthan"), ("decimal_greaterthanorequal", "greaterthanorequal"), ("decimal_lessthan", "lessthan"), ("decimal_lessthanorequal", "lessthanorequal"), ("decimal_equalto", "equalto"), ("decimal_notequalto", "notequalto")):
    FUNCTIONS[_n] = FUNCTIONS[_of]


# ---- transforms of partitioned tables

FUNCTIONS |= {
    "years": lambda d: F.year(d) - 1970, "months": lambda d: (F.year(d) - 1970) * 12 + F.month(d) - 1, "days": lambda d: F.datediff(_c(d), F.lit("1970-01-01").cast("date")),
    "hours": lambda t: F.floor(F.unix_seconds(_c(t).cast("timestamp")) / 3600).cast("int"), "truncate_number": lambda x, w: _c(x) - F.pmod(_c(x), F.lit(w)), "truncate_text": lambda s, w: F.left(_c(s), F.lit(w)),
}


# ---- text of a fixed or a bounded length


def _no_longer(s: Column, n: int) -> Column:
    """Spaces beyond n characters go; anything else there is an error."""
    return F.when(F.length(F.rtrim(s)) <= n, F.left(s, F.lit(n))).otherwise(F.raise_error(F.lit(f"exceeds a length of {n}")))


FUNCTIONS |= {
    "read_side_padding": lambda s, n: F.when(F.length(_c(s)) < n, F.rpad(_c(s), n, " ")).otherwise(_c(s)),
    "varchar_type_write_side_check": lambda s, n: F.when(F.length(_c(s)) <= n, _c(s)).when(_c(s).isNotNull(), _no_longer(_c(s), n)),
    "char_type_write_side_check": lambda s, n: F.when(F.length(_c(s)) <= n, F.rpad(_c(s), n, " ")).when(_c(s).isNotNull(), _no_longer(_c(s), n)),
}
