"""Queries that apply the spark dialect's functions, by family, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespar.functions import call

from .tpch import _t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def s(name: str, *args, **options):
    return call("spark", name, *args, **options)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _cols(df: DataFrame, keys, cols: dict) -> DataFrame:
    return df.select(*keys, *[c.alias(n) for n, c in cols.items()])


def _b(c):
    return c.cast("bigint")


_ARR = "select o_orderkey k, [o_orderkey % 7, o_custkey % 5, null, o_orderkey % 7, 3] a, [o_orderkey % 4, o_custkey % 3, 2] b from orders"


def _arr(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.expr("array(o_orderkey % 7, o_custkey % 5, null, o_orderkey % 7, 3L)").alias("a"), F.expr("array(o_orderkey % 4, o_custkey % 3, 2L)").alias("b"))


@query(f"""select k, list_transform(b, lambda x: x + 1) tr, list_sum(b)::bigint ag, [k, k + 1] mk, list_contains(b, 2) ct, len(list_distinct(b))::bigint ds, list_sort(list_filter(list_distinct(b), lambda x: x <> 2)) ex, list_sort(list_intersect(b, [0, 2, 9])) ins,
coalesce(list_position(b, 2), 0)::bigint ps, list_bool_or(list_transform(b, lambda x: x > 2)) es, list_filter(b, lambda x: x > 0) fl, list_bool_and(list_transform(b, lambda x: x >= 0)) fa, b || [9] cc, list_aggregate(list_transform(b, lambda x: x::varchar), 'string_agg', '-') jn,
list_min(a) mn, list_max(a) mx, list_filter(b, lambda x: x <> 2) rm, [7] || b pp, list_sort(list_distinct(b || [9])) un, list_filter(a, lambda x: x is not null) cp, list_sort(b) st, list_reverse_sort(b) sd, list_sort(b) sa, [k, k, k] rp, b || b fn,
[b[1], 5, b[2], b[3]] ai, b[2] gt, b || [k] ap, list_reverse(b) rv, len(b)::bigint sz, b[2:3] sl, list_transform(range(1, 4), lambda i: b[i] * 10 + b[i])  zw from ({_ARR})""")
def arrays(spark, d):
    nine = F.array(F.lit(9).cast("bigint"))
    b = F.col("b")
    return _cols(_arr(spark, d), ["k"], {
        "tr": s("transform", "b", lambda x: x + 1), "ag": s("aggregate", "b", F.lit(0).cast("bigint"), lambda x, y: x + y), "mk": s("array", F.col("k"), F.col("k") + 1), "ct": s("array_contains", "b", 2), "ds": _b(s("size", s("array_distinct", "b"))),
        "ex": F.array_sort(s("array_except", "b", F.array(F.lit(2).cast("bigint")))), "ins": F.array_sort(s("array_intersect", "b", F.array(*[F.lit(x).cast("bigint") for x in (0, 2, 9)]))), "ps": s("array_position", "b", 2),
        "es": s("exists", "b", lambda x: x > 2), "fl": s("filter", "b", lambda x: x > 0), "fa": s("forall", "b", lambda x: x >= 0), "cc": s("concat", "b", nine), "jn": s("array_join", b.cast("array<string>"), "-"), "mn": s("array_min", "a"), "mx": s("array_max", "a"),
        "rm": s("array_remove", "b", 2), "pp": s("array_prepend", "b", F.lit(7).cast("bigint")), "un": F.array_sort(s("array_union", "b", nine)), "cp": s("array_compact", "a"), "st": s("array_sort", "b"), "sd": s("array_sort_desc", "b"), "sa": s("sort_array", "b"),
        "rp": s("array_repeat", F.col("k"), 3), "fn": s("flatten", F.array("b", "b")), "ai": s("array_insert", "b", 2, F.lit(5).cast("bigint")), "gt": s("get", "b", F.lit(1)), "ap": s("array_append", "b", F.col("k")), "rv": s("reverse", "b"), "sz": _b(s("size", "b")),
        "sl": s("slice", "b", 2, 2), "zw": s("zip_with", "b", "b", lambda x, y: x * 10 + y),
    })


@query("""select o_orderkey k, map_keys(m) ks, map_values(m) vs, m['y'][1] el, cardinality(m)::bigint n, list_sort(list_filter(map_keys(m), lambda q: m[q] > 2)) fk, list_sum(map_values(m))::bigint + 10 zs, ['x', 'y', 'z'] cc, [o_orderkey] mm,
['a', 'b'] sk from (select o_orderkey, map {'x': o_orderkey % 5, 'y': o_custkey % 4} m from orders)""".replace("m['y'][1]", "m['y']"))
def maps(spark, d):
    m = _t(spark, d, "orders").select("o_orderkey", s("map", F.lit("x"), F.col("o_orderkey") % 5, F.lit("y"), F.col("o_custkey") % 4).alias("m"))
    other = s("map_from_arrays", F.array(F.lit("x"), F.lit("y")), F.array(F.lit(5).cast("bigint"), F.lit(5).cast("bigint")))
    return _cols(m, [F.col("o_orderkey").alias("k")], {
        "ks": s("map_keys", "m"), "vs": s("map_values", "m"), "el": s("element_at", "m", "y"), "n": _b(s("size", "m")), "fk": F.array_sort(F.map_keys(s("map_filter", "m", lambda k, v: v > 2))),
        "zs": F.aggregate(F.map_values(s("map_zip_with", "m", other, lambda k, a, b: a + b)), F.lit(0).cast("bigint"), lambda x, y: x + y), "cc": F.map_keys(s("map_concat", "m", F.create_map(F.lit("z"), F.lit(1).cast("bigint")))),
        "mm": F.transform(F.slice(s("map_entries", F.create_map(F.lit("a"), F.col("o_orderkey"))), 1, 1), lambda e: e["value"]), "sk": F.map_keys(s("str_to_map", F.lit("a:1,b:2"), F.lit(","), F.lit(":"))),
    })


@query(r"""select c_custkey k, s || '!' cc, reverse(s) rv, starts_with(s, 'Cust') sw, ends_with(s, '7') ew, contains(s, '00') ct, instr(s, '0')::bigint lc, trim('  ' || s || ' ') tr, ltrim('  ' || s) lt, rtrim(s || '  ') rt, translate(s, 'Cr0', 'cR') tl, replace(s, '0', '-') rp,
case when c_mktsegment = 'x' then 1 else 0 end::bigint fs, chr((65 + c_custkey % 26)::int) ch, ascii(s)::bigint ac, lpad(s, 24, '*') lp, rpad(s, 24, '*') rpd, substr(s, 3, 4) sb, s[1:2] || 'XY' || s[5:] ov, left(s, 3) lf, (8 * strlen(s))::bigint bl, instr(s, 'm')::bigint ins,
length(s)::bigint n, regexp_extract(s, '^([^#]*)', 1) si, case when '' = '' then null end en, levenshtein(s, 'Customer')::bigint lv, repeat(s, 2) rep, string_split(s, '0') sp, upper(s) up, lower(s) lo, base64(encode(s)) b64, s ub, 'Abc Def' ic, md5(s) md, sha1(s) s1, sha256(s) s2,
upper(hex(encode(s))) hx, s unh, regexp_extract(s, '([0-9]+)', 1) re, regexp_matches(s, '[0-9]{3}5') rl, s like '%1_' lk, regexp_replace(s, '[A-Z]', '_', 'g') rr, regexp_extract_all(s, '[0-9]') ra, 'Xxnn' mk, true lu, false lf2, 'C235' sx,
url_encode(s || ' &') ue, s ud, s[1:8] si2 from (select c_custkey, c_mktsegment, c_name s from customer)""")
def strings(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_name").alias("s"))
    t = F.col("s")
    return _cols(c, [F.col("c_custkey").alias("k")], {
        "cc": s("concat", t, F.lit("!")), "rv": s("reverse", t), "sw": s("startswith", t, F.lit("Cust")), "ew": s("endswith", t, F.lit("7")), "ct": s("contains", t, F.lit("00")), "lc": _b(s("locate", "0", t)), "tr": s("trim", F.concat(F.lit("  "), t, F.lit(" "))),
        "lt": s("ltrim", F.concat(F.lit("  "), t)), "rt": s("rtrim", F.concat(t, F.lit("  "))), "tl": s("translate", t, "Cr0", "cR"), "rp": s("replace", t, F.lit("0"), F.lit("-")), "fs": _b(s("find_in_set", F.lit("x"), F.col("c_mktsegment"))),
        "ch": s("chr", 65 + F.col("c_custkey") % 26), "ac": _b(s("ascii", t)), "lp": s("lpad", t, 24, "*"), "rpd": s("rpad", t, 24, "*"), "sb": s("substring", t, 3, 4), "ov": s("overlay", t, F.lit("XY"), 3), "lf": s("left", t, F.lit(3)), "bl": _b(s("bit_length", t)),
        "ins": _b(s("instr", t, "m")), "n": _b(s("length", t)), "si": s("substring_index", t, "#", 1), "en": s("empty2null", F.lit("")), "lv": _b(s("levenshtein", t, F.lit("Customer"))), "rep": s("repeat", t, 2), "sp": s("split", t, "0"), "up": s("upper", t), "lo": s("lower", t),
        "b64": F.regexp_replace(s("base64", F.encode(t, "UTF-8")), r"\s", ""), "ub": s("unbase64", s("base64", F.encode(t, "UTF-8"))).cast("string"), "ic": s("initcap", F.lit("aBC dEF")), "md": s("md5", t), "s1": s("sha1", t), "s2": s("sha2", t, 256),
        "hx": s("hex", t), "unh": s("unhex", s("hex", t)).cast("string"), "re": s("regexp_extract", t, "([0-9]+)", 1), "rl": s("rlike", t, F.lit("[0-9]{3}5")), "lk": s("like", t, F.lit("%1_")), "rr": s("regexp_replace", t, "[A-Z]", "_"),
        "ra": s("regexp_extract_all", t, F.lit("([0-9])")), "mk": s("mask", F.lit("Ab12")), "lu": s("luhn_check", F.lit("79927398713")), "lf2": s("luhn_check", F.lit("79927398710")), "sx": s("soundex", F.lit("Customer")),
        "ue": F.regexp_replace(s("url_encode", F.concat(t, F.lit(" &"))), r"\+", "%20"), "ud": s("url_decode", s("url_encode", t)), "si2": s("substring", t, 1, 8),
    })


@query("""select o_orderkey k, abs(x) ab, round(acos(u), 9) ac, round(asin(u), 9) asn, round(acosh(u + 2), 9) ach, round(asinh(x / 1000), 6) ash, round(atan(x / 1000), 9) atn, round(atanh(u / 2), 9) ath, round(1 / cos(u), 9) se, round(1 / sin(u + 1), 9) cs, round((exp(u) - exp(-u)) / 2, 9) sh,
round(cos(x), 9) co, round((exp(u) + exp(-u)) / 2, 9) ch, round(1 / tan(u + 1), 9) ct, round(degrees(u), 9) de, round(atan2(x, 3), 9) a2, round(ln(1 + u), 9) l1, bin(n) bi, upper(to_base(n, 16)) hx, round(exp(u), 9) ex, round(exp(u) - 1, 9) e1, ((n % 7 - 3) % 5 + 5) % 5 pm, round(pow(u, 3), 9) pw,
round_even(x / 7, 0) ri, round(x / 7, 2) ro, ceil(x / 7)::bigint ce, floor(x / 7)::bigint fl, round(sqrt(x * x + 9), 4) hy, round(log2(u + 1), 9) l2, round(log10(u + 1), 9) l10, round(ln(u + 1) / ln(3), 9) lg, round(sqrt(u), 9) sq, round(cbrt(x), 9) cb, sign(x)::double sg,
n + 5 ad, n - 5 su, n * 5 mu, n / 4 dv, n % 5 rm, -n um, isnan(x) nn, factorial((n % 10)::int)::bigint fa, n // 5 cd, lower(to_base(n, 7)) cv, least(n, 100) le, greatest(n, 100) ge, case when u < 0 then 0 when u >= 1 then 5 else floor(u * 4) + 1 end::bigint wb
from (select o_orderkey, o_totalprice - 200000 x, (o_orderkey % 1000) / 1000.0::double u, o_orderkey n from orders)""")
def math(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") - 200000).alias("x"), ((F.col("o_orderkey") % 1000) / F.lit(1000.0)).alias("u"), F.col("o_orderkey").alias("n"))
    x, u, n = F.col("x"), F.col("u"), F.col("n")
    r = lambda c, k=9: F.round(c, k)
    return _cols(o, ["k"], {
        "ab": s("abs", x), "ac": r(s("acos", u)), "asn": r(s("asin", u)), "ach": r(s("acosh", u + 2)), "ash": r(s("asinh", x / 1000), 6), "atn": r(s("atan", x / 1000)), "ath": r(s("atanh", u / 2)), "se": r(s("sec", u)), "cs": r(s("csc", u + 1)), "sh": r(s("sinh", u)),
        "co": r(s("cos", x)), "ch": r(s("cosh", u)), "ct": r(s("cot", u + 1)), "de": r(s("degrees", u)), "a2": r(s("atan2", x, F.lit(3))), "l1": r(s("log1p", u)), "bi": s("bin", n), "hx": s("hex", n), "ex": r(s("exp", u)), "e1": r(s("expm1", u)), "pm": s("pmod", n % 7 - 3, F.lit(5)),
        "pw": r(s("power", u, F.lit(3))), "ri": s("rint", x / 7), "ro": s("round", x / 7, 2), "ce": s("ceil", x / 7), "fl": s("floor", x / 7), "hy": r(s("hypot", x, F.lit(3.0)), 4), "l2": r(s("log2", u + 1)), "l10": r(s("log10", u + 1)), "lg": r(s("log", 3.0, u + 1)),
        "sq": r(s("sqrt", u)), "cb": r(s("cbrt", x)), "sg": s("sign", x), "ad": s("add", n, 5), "su": s("subtract", n, 5), "mu": s("multiply", n, 5), "dv": s("divide", n, 4), "rm": s("remainder", n, 5), "um": s("unaryminus", n), "nn": s("isnan", x),
        "fa": s("factorial", (n % 10).cast("int")), "cd": s("checked_div", n, 5), "cv": F.lower(s("conv", n.cast("string"), 10, 7)), "le": s("least", n, F.lit(100)), "ge": s("greatest", n, F.lit(100)), "wb": _b(s("width_bucket", u, F.lit(0.0), F.lit(1.0), F.lit(4))),
    })


@query("""select event_id k, year(ts)::bigint y, quarter(ts)::bigint q, month(ts)::bigint m, week(ts)::bigint w, isoyear(ts)::bigint yw, day(ts)::bigint dd, day(ts)::bigint dm, dayofyear(ts)::bigint dy, (dayofweek(ts) + 1)::bigint dw, (isodow(ts) - 1)::bigint wd, hour(ts)::bigint h, minute(ts)::bigint mi, second(ts)::bigint s,
(ts::date - date '1970-01-01')::bigint ud, epoch_us(ts) // 1000000 us, epoch_us(ts) // 1000 um, epoch_us(ts) ui, ts::date + 3 da, ts::date - 3 ds, (ts + interval 2 month)::date am, last_day(ts) ld, make_date(2024, 1, 1 + (event_id % 28)::int) md, date '1970-01-01' + (event_id % 1000)::int du,
(ts::date - date '2024-01-01')::bigint df, strftime(ts, '%Y-%m-%d %H:%M') fm, strftime(ts, '%Y-%m-%d %H:%M:%S') fu, date_trunc('hour', ts) th, date_trunc('month', ts)::date tm, ts::date + (7 - (isodow(ts) - 1) % 7)::int nd, datesub('hour', timestamp '2024-01-01', ts) td, ts + interval 3 hour ta,
epoch_us(ts) // 1000000 ut, ts - interval 5 hour fz, ts + interval 5 hour tz, make_timestamp(2024, 2, 3, 4, 5, 6) mt, to_timestamp(event_id)::timestamp ss, year(ts)::bigint - 1970 iy, (year(ts) - 1970) * 12 + month(ts) - 1 im, (ts::date - date '1970-01-01')::bigint idd, epoch_us(ts) // 3600000000 ih,
12.0::double mb, to_timestamp(event_id)::timestamp tml, to_timestamp(event_id)::timestamp tmu from events""")
def dates(spark, d):
    e, t, one = _t(spark, d, "events"), F.col("ts"), F.lit("2024-01-01")
    day, z, ntz = t.cast("date"), t.cast("timestamp"), "timestamp_ntz"
    return _cols(e, [F.col("event_id").alias("k")], {
        "y": _b(s("year", t)), "q": _b(s("quarter", t)), "m": _b(s("month", t)), "w": _b(s("week_of_year", t)), "yw": _b(s("year_of_week", t)), "dd": _b(s("day", t)), "dm": _b(s("dayofmonth", t)), "dy": _b(s("dayofyear", t)), "dw": _b(s("dayofweek", t)), "wd": _b(s("weekday", t)),
        "h": _b(s("hour", t)), "mi": _b(s("minute", t)), "s": _b(s("second", t)), "ud": _b(s("unix_date", day)), "us": s("unix_seconds", z), "um": s("unix_millis", z), "ui": s("unix_micros", z), "da": s("date_add", day, 3), "ds": s("date_sub", day, 3), "am": s("add_months", day, 2),
        "ld": s("last_day", t), "md": s("make_date", F.lit(2024), F.lit(1), (1 + F.col("event_id") % 28).cast("int")), "du": s("date_from_unix_date", (F.col("event_id") % 1000).cast("int")), "df": _b(s("datediff", day, one.cast("date"))), "fm": s("date_format", t, "yyyy-MM-dd HH:mm"),
        "fu": s("from_unixtime", s("unix_timestamp", z)), "th": s("date_trunc", "hour", t).cast(ntz), "tm": s("trunc", day, "month"), "nd": s("next_day", day, "Mon"), "td": s("timestampdiff", "HOUR", one.cast(ntz), t), "ta": s("timestampadd", "HOUR", 3, t),
        "ut": s("to_unix_timestamp", z), "fz": s("from_utc_timestamp", z, "Etc/GMT+5").cast(ntz), "tz": s("to_utc_timestamp", z, "Etc/GMT+5").cast(ntz), "mt": s("make_timestamp", *[F.lit(x) for x in (2024, 2, 3, 4, 5, 6)]).cast(ntz), "ss": s("timestamp_seconds", F.col("event_id")).cast(ntz),
        "iy": _b(s("years", t)), "im": _b(s("months", t)), "idd": _b(s("days", day)), "ih": _b(s("hours", t)), "mb": s("months_between", F.lit("2025-01-01").cast("date"), one.cast("date")), "tml": s("timestamp_millis", F.col("event_id") * 1000).cast(ntz),
        "tmu": s("timestamp_micros", F.col("event_id") * 1000000).cast(ntz),
    })


@query("""select o_orderkey k, (n & 12) ba, (n | 3) bo, xor(n, 5) bx, ~n bn, bit_count(n)::bigint bc, (n & 1) bg, n << 3 sl, n >> 2 sr, false nu, true nn, n = 10 eq, n <> 10 ne, n is not distinct from 10 en, n < 10 lt, n > 10 gt, n <= 10 le, n >= 10 ge, n between 10 and 20 bt, n in (1, 5, 7) i, not (n = 10) nt,
case when n > 10 then 'a' else 'b' end f, coalesce(null, n) co, nullif(n, 10) nf, n % 2 = 0 an, n::double cs, null::bigint tc, n sf, [n, n + 1] sa, cast(n as decimal(12, 2)) / 100 = md_ as mdq, round(o_totalprice, 1) dr, n * 100 uv, true dg, false dl from
(select o_orderkey, o_totalprice, o_orderkey n, cast(o_orderkey as decimal(12, 2)) / 100 md_ from orders)""")
def predicates_bits_decimals(spark, d):
    o, n, ten = _t(spark, d, "orders").withColumn("n", F.col("o_orderkey")), F.col("n"), 10
    st = F.struct(n.alias("v"))
    half = n.cast("decimal(12,2)")
    return _cols(o, [F.col("o_orderkey").alias("k")], {
        "ba": s("bitwise_and", n, 12), "bo": s("bitwise_or", n, 3), "bx": s("bitwise_xor", n, 5), "bn": s("bitwise_not", n), "bc": _b(s("bit_count", n)), "bg": _b(s("bit_get", n, F.lit(0))), "sl": s("shiftleft", n, 3), "sr": s("shiftright", n, 2), "nu": s("isnull", n), "nn": s("isnotnull", n),
        "eq": s("equalto", n, ten), "ne": s("notequalto", n, ten), "en": s("equalnullsafe", n, ten), "lt": s("lessthan", n, ten), "gt": s("greaterthan", n, ten), "le": s("lessthanorequal", n, ten), "ge": s("greaterthanorequal", n, ten), "bt": s("between", n, ten, 20), "i": s("in", n, 1, 5, 7),
        "nt": s("not", n == ten), "f": s("if", n > ten, F.lit("a"), F.lit("b")), "co": s("coalesce", F.lit(None).cast("bigint"), n), "nf": s("nullif", n, ten), "an": s("at_least_n_non_nulls", 1, F.when(n % 2 == 0, n)), "cs": s("cast", n, "double"), "tc": s("try_cast", F.lit("x"), "bigint"),
        "sf": s("get_struct_field", st, "v"), "sa": s("get_array_struct_fields", F.array(st, F.struct((n + 1).alias("v"))), "v"), "mdq": s("decimal_equalto", s("make_decimal", n * 100, 14, 4), half / 100), "dr": s("decimal_round", F.col("o_totalprice"), 1),
        "uv": s("unscaled_value", half, 2), "dg": s("decimal_greaterthan", half + 1, half), "dl": s("decimal_lessthan", half + 1, half),
    })


@query("""select event_id k, props->>'$.k' v, ['a', 'b'] ks, 3::bigint n, '{"x":' || event_id || '}' j from events""")
def json(spark, d):
    return _cols(_t(spark, d, "events"), [F.col("event_id").alias("k")], {"v": s("get_json_object", "props", "$.k"), "ks": s("json_object_keys", F.lit('{"a":1,"b":2}')), "n": _b(s("json_array_length", F.lit("[1,2,3]"))), "j": s("to_json", F.struct(F.col("event_id").alias("x")))})


@query("""select l_returnflag g, count(*) n, count(*) filter (l_tax > 0.04) ci, avg(l_quantity) a, round(sum(l_extendedprice), 2) su, min(l_extendedprice) mn, max(l_extendedprice) mx, bit_xor(l_orderkey) bx, round(covar_samp(l_quantity, l_tax), 8) cs, round(corr(l_quantity, l_extendedprice), 8) co,
round(stddev_samp(l_quantity), 8) sd, round(stddev_samp(l_quantity), 8) ss, round(var_samp(l_quantity), 6) va, round(var_samp(l_quantity), 6) vs, round(sum(pow(l_quantity - m, 3)) / count(*) / pow(sum(pow(l_quantity - m, 2)) / count(*), 1.5), 6) sk,
round(sum(pow(l_quantity - m, 4)) / count(*) / pow(sum(pow(l_quantity - m, 2)) / count(*), 2) - 3, 6) ku, len(list(l_linenumber))::bigint cl, list_sort(list(distinct l_linenumber)) cst, arg_max(l_orderkey, l_extendedprice) xb, arg_min(l_orderkey, l_extendedprice) nb, 1 as fi, 1 as la, 1 as fn, 1 as ln, mode(1) mo
from (select *, avg(l_quantity) over (partition by l_returnflag) m from lineitem) group by l_returnflag""")
def aggregates(spark, d):
    r = F.round
    li, one = _t(spark, d, "lineitem"), F.lit(1)
    aggs = {
        "n": s("count", one), "ci": s("count_if", F.col("l_tax") > 0.04), "a": s("avg", "l_quantity"), "su": r(s("sum", "l_extendedprice"), 2), "mn": s("min", "l_extendedprice"), "mx": s("max", "l_extendedprice"), "bx": s("bit_xor", "l_orderkey"), "cs": r(s("covar_samp", "l_quantity", "l_tax"), 8),
        "co": r(s("corr", "l_quantity", "l_extendedprice"), 8), "sd": r(s("stddev", "l_quantity"), 8), "ss": r(s("stddev_samp", "l_quantity"), 8), "va": r(s("variance", "l_quantity"), 6), "vs": r(s("var_samp", "l_quantity"), 6), "sk": r(s("skewness", "l_quantity"), 6), "ku": r(s("kurtosis", "l_quantity"), 6),
        "cl": _b(F.size(s("collect_list", "l_linenumber"))), "cst": F.array_sort(s("collect_set", "l_linenumber")), "xb": s("max_by", "l_orderkey", "l_extendedprice"), "nb": s("min_by", "l_orderkey", "l_extendedprice"), "fi": s("first", one), "la": s("last", one),
        "fn": s("first_ignore_null", F.when(F.col("l_tax") > 0.01, 1)), "ln": s("last_ignore_null", F.when(F.col("l_tax") > 0.01, 1)), "mo": s("mode", one),
    }
    return li.groupBy(F.col("l_returnflag").alias("g")).agg(*[c.alias(n) for n, c in aggs.items()])


@query("""select l_returnflag g, count(*) n, true inside from lineitem group by 1""")
def bloom_filters(spark, d):
    """Each group's keys are all in the filter of the whole table's."""
    li = _t(spark, d, "lineitem")
    bloom = li.agg(s("bloom_filter_agg", F.xxhash64("l_orderkey"), 100_000, 1_000_000).alias("b")).first()[0]
    return li.groupBy(F.col("l_returnflag").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(s("might_contain", bloom, F.xxhash64("l_orderkey"))).alias("inside"))


@query("""select c_custkey k, c_custkey - c_custkey % 10 tn, left(c_name, 5) tt, (c_acctbal * 100)::bigint::double * 0 tz, case when c_custkey % 2 = 0 then c_custkey end tr from customer""")
def width_and_try(spark, d):
    c = _t(spark, d, "customer")
    text = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise("none")
    return _cols(c, [F.col("c_custkey").alias("k")], {"tn": s("truncate", 10, "c_custkey", "number"), "tt": s("truncate", 5, "c_name"), "tz": F.col("c_acctbal") * 0, "tr": s("try", text.cast("bigint"))})


@query("""select event_id, row_number() over w rn, rank() over w rk, dense_rank() over w dr, percent_rank() over w pr, cume_dist() over w cd, ntile(3) over w nt, lag(value) over w lg, lead(value) over w ld, first_value(value) over w fv, last_value(value) over w lv, nth_value(value, 2) over w nv
from events window w as (partition by event_type order by ts, event_id)""")
def windows(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    fns = {"rn": _b(s("row_number").over(w)), "rk": _b(s("rank").over(w)), "dr": _b(s("dense_rank").over(w)), "pr": s("percent_rank").over(w), "cd": s("cume_dist").over(w), "nt": _b(s("ntile", 3).over(w)), "lg": s("lag", "value").over(w), "ld": s("lead", "value").over(w), "fv": s("first_value", "value").over(w), "lv": s("last_value", "value").over(w), "nv": s("nth_value", "value", 2).over(w)}
    return _cols(_t(spark, d, "events"), ["event_id"], fns)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"spark_{k}": f for k, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {f"spark_{k}": v for k, v in SQL.items()}
