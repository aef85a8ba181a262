"""Queries that apply the rest of the ansi dialect, by family, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespar.functions import aggregates as A
from lodespar.functions import call

from .tpch import _t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def p(name: str, *args, **options):
    return call("ansi", name, *args, **options)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _cols(df: DataFrame, keys, cols: dict) -> DataFrame:
    return df.select(*keys, *[c.alias(n) for n, c in cols.items()])


def _spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, where a small file would put much work per row into few tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _b(c):
    return c.cast("bigint")


def _arr(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.expr("array(o_orderkey % 7, o_custkey % 5, null, o_orderkey % 7, 3L)").alias("a"), F.expr("array(o_orderkey % 4, o_custkey % 3, 2L)").alias("b"), F.expr("array(o_orderkey % 4 + 1.0D, o_custkey % 3 + 0.5D, 2.0D)").alias("v"))


_A = """select o_orderkey k, [o_orderkey % 7, o_custkey % 5, null, o_orderkey % 7, 3] a, [o_orderkey % 4, o_custkey % 3, 2] b, [(o_orderkey % 4)::double + 1.0, (o_custkey % 3)::double + 0.5, 2.0] v from orders"""


@query(f"""select k, list_sort(list_distinct(b)) ds, list_sort(list_filter(list_distinct(b), lambda x: x <> 2)) ex, list_aggregate(list_transform(b, lambda x: x::varchar), 'string_agg', ',') jn, list_sort(b) st, list_reverse_sort(b) sd, list_sort(list_distinct(b || [9])) au, b || b fl,
list_bool_and(list_transform(b, lambda x: x >= 0)) am, list_bool_or(list_transform(b, lambda x: x > 2)) an, list_filter(b, lambda x: x > 0) fi, list_transform(b, lambda x: x * 2) tr, [k, 7] ac, list_sort(list_filter(list_distinct(b), lambda x: len(list_filter(b, lambda y: y = x)) > 1)) du,
map_from_entries(list_transform(list_sort(list_distinct(b)), lambda x: (x, len(list_filter(b, lambda y: y = x))::bigint))) fr, list_sort(list_intersect(b, [0, 2])) ins, list_max(b) xb, list_min(b) nb, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 9)) no, [b[1], b[3]] su,
[[b[1], b[2]], [b[1], b[3]], [b[2], b[3]]] cb, round(list_sum(list_transform(v, lambda x: x * x)), 6) dp, 1.0 co, 0.0 l2, coalesce(list_position(list_transform(b, lambda x: x > 1), true), 0)::bigint fx, [1, 2, 3] sq, b[2:3] sl, [k, k] rp, b[2] sb, list_transform([1, 2, 3], lambda i: b[i] + 1) zw,
len(list_filter([0.0, 1.0, 2.0], lambda x: x <= v[1]))::bigint wb, len(b)::bigint sz from ({_A})""")
def arrays(spark, d):
    b = F.col("b")
    big = lambda *xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    freq = p("array_frequency", "b")
    keys = F.array_sort(F.map_keys(freq))
    return _cols(_arr(spark, d), ["k"], {
        "ds": F.array_sort(p("array_distinct", "b")), "ex": F.array_sort(p("array_except", "b", big(2))), "jn": p("array_join", b.cast("array<string>"), ","), "st": p("array_sort", "b"), "sd": p("array_sort_desc", "b"), "au": F.array_sort(p("arrays_union", "b", big(9))), "fl": p("flatten", F.array("b", "b")),
        "am": p("all_match", "b", lambda x: x >= 0), "an": p("any_match", "b", lambda x: x > 2), "fi": p("filter", "b", lambda x: x > 0), "tr": p("transform", "b", lambda x: x * 2), "ac": p("array_constructor", F.col("k"), F.lit(7).cast("bigint")), "du": F.array_sort(p("array_duplicates", "b")),
        "fr": F.map_from_arrays(keys, F.transform(keys, lambda q: F.element_at(freq, q).cast("bigint"))), "ins": F.array_sort(p("array_intersect", "b", big(0, 2))), "xb": p("array_max_by", "b", lambda x: x), "nb": p("array_min_by", "b", lambda x: x),
        "no": F.transform(p("array_normalize", "v", 2.0), lambda x: F.round(x, 9)), "su": p("array_subset", "b", F.array(F.lit(3), F.lit(1))), "cb": p("combinations", "b", 2), "dp": F.round(p("dot_product", "v", "v"), 6), "co": F.round(p("cosine_similarity", "v", "v"), 9).cast("decimal(2,1)"),
        "l2": p("l2_squared", "v", "v").cast("decimal(2,1)"), "fx": F.coalesce(p("find_first_index", "b", lambda x: x > 1), F.lit(0).cast("bigint")), "sq": p("sequence", F.lit(1), F.lit(3)), "sl": p("slice", "b", 2, 2), "rp": p("repeat", F.col("k"), 2), "sb": p("subscript", b, 2),
        "zw": p("zip_with", "b", F.array(*[F.lit(1).cast("bigint")] * 3), lambda x, y: x + y), "wb": p("width_bucket", F.get("v", F.lit(0)), F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0))), "sz": _b(F.size(p("shuffle", "b"))),
    })


@query("""select o_orderkey k, true ak, true yk, y > 1 yv, true nk, not (x > 3 or y > 3) nv, ['x', 'y', 'z'] mc, ['x'] sb, ['q', 'y'] rk, ['x'] rn, 2::bigint en, case when x >= y then 'x' end tk, greatest(x, y) tv, ['y', 'x'] tn, 2::bigint ts, [x + 1, y + 1] tr, ['xx', 'yx'] kk, x + y + x zs, [x, y] mk, [o_orderkey, 7] mm, 1.0 cs,
round(x / (x + y + 1), 9) nm, ['x', 'y'] ml from (select o_orderkey, o_orderkey % 5 x, o_custkey % 4 y from orders)""")
def maps(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("x"), (F.col("o_custkey") % 4).alias("y")).withColumn("m", F.create_map(F.lit("x"), F.col("x"), F.lit("y"), F.col("y")))
    x, y = F.col("x"), F.col("y")
    doubles = F.create_map(F.lit("x"), x.cast("double"), F.lit("y"), (y + 1).cast("double"))
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), F.lit(v).cast("bigint").alias("value"))
    multi = p("multimap_from_entries", F.array(F.struct(F.lit("a").alias("key"), F.col("o_orderkey").alias("value")), entry("a", 7)))
    return _cols(o, [F.col("o_orderkey").alias("k")], {
        "ak": p("all_keys_match", "m", lambda q: F.length(q) == 1), "yk": p("any_keys_match", "m", lambda q: q == "x"), "yv": p("any_values_match", F.create_map(F.lit("y"), y), lambda v: v > 1), "nk": p("no_keys_match", "m", lambda q: q == "z"), "nv": p("no_values_match", "m", lambda v: v > 3),
        "mc": F.array_sort(F.map_keys(p("map_concat", "m", F.create_map(F.lit("z"), F.lit(1).cast("bigint"))))), "sb": F.map_keys(p("map_subset", "m", F.array(F.lit("x"), F.lit("n")))), "rk": F.array_sort(F.map_keys(p("remap_keys", "m", F.array(F.lit("x")), F.array(F.lit("q"))))),
        "rn": F.map_keys(p("map_remove_null_values", F.create_map(F.lit("x"), x, F.lit("n"), F.lit(None).cast("bigint")))), "en": _b(F.size(p("map_entries", "m"))), "tk": F.when(x >= y, F.when(x == y, F.lit("x")).otherwise(F.get(p("map_keys_by_top_n_values", "m", 1), F.lit(0)))),
        "tv": F.get(p("map_top_n_values", "m", 1), F.lit(0)), "tn": p("map_top_n_keys", "m", 2), "ts": _b(F.size(p("map_top_n", "m", 2))), "tr": F.map_values(p("transform_values", "m", lambda q, v: v + 1)), "kk": F.map_keys(p("transform_keys", "m", lambda q, v: F.concat(q, F.lit("x")))),
        "zs": F.aggregate(F.map_values(p("map_zip_with", "m", F.create_map(F.lit("x"), F.col("x")), lambda q, u, v: u + F.coalesce(v, F.lit(0).cast("bigint")))), F.lit(0).cast("bigint"), lambda s, v: s + v), "mk": F.map_values(p("map_from_entries", F.map_entries("m"))), "mm": F.element_at(multi, "a"),
        "cs": F.round(p("map_cosine_similarity", doubles, doubles), 9).cast("decimal(2,1)"), "nm": F.round(F.element_at(p("map_normalize", doubles), "x"), 9), "ml": F.map_keys(p("map", F.array(F.lit("x"), F.lit("y")), F.array(x, y))),
    })


@query("""select o_orderkey k, round(acos(u), 9) ac, round(asin(u), 9) asn, round(atan(u), 9) atn, round(cosh(u), 9) ch, round(tanh(u), 9) th, round(pow(u, 2), 9) pw, ceil(u * 7)::bigint ce, (n + 1) pl, (n - 1) mi, (n * 2) mu, (n % 5) mo, -n ng, n = 10 eq, n <> 10 ne, n < 10 lt, n <= 10 le, n > 10 gt, n >= 10 ge, n in (1, 5) i, n is null nu, not (n = 10) nt,
greatest(n, 100) gr, least(n, 100) ls, ~n bn, (n << 2) & 255 sl, (n & 255) >> 2 lr, n >> 2 ar, n >> 2 ra, n / 4 dd, n fb, 'bigint' ty, false iff, round(pi(), 9) pi, round(exp(1), 9) e, true inf, true nan, 1024.0 ds, 0.5::double wl, u >= 0 rn, true rr, n + 1 tr from (select o_orderkey, o_orderkey n, (o_orderkey % 1000) / 1000.0::double u from orders)""")
def numbers(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("n"), ((F.col("o_orderkey") % 1000) / F.lit(1000.0)).alias("u"))
    n, u, r = F.col("n"), F.col("u"), lambda c: F.round(c, 9)
    drawn = p("random", 10)
    return _cols(o, ["k"], {
        "ac": r(p("acos", u)), "asn": r(p("asin", u)), "atn": r(p("atan", u)), "ch": r(p("cosh", u)), "th": r(p("tanh", u)), "pw": r(p("power", u, F.lit(2))), "ce": p("ceiling", u * 7), "pl": p("plus", n, 1), "mi": p("minus", n, 1), "mu": p("multiply", n, 2), "mo": p("modulus", n, 5), "ng": p("negate", n),
        "eq": p("eq", n, 10), "ne": p("neq", n, 10), "lt": p("lt", n, 10), "le": p("lte", n, 10), "gt": p("gt", n, 10), "ge": p("gte", n, 10), "i": p("in", n, 1, 5), "nu": p("is_null", n), "nt": p("not", n == 10), "gr": p("greatest", n, F.lit(100).cast("bigint")), "ls": p("least", n, F.lit(100).cast("bigint")),
        "bn": p("bitwise_not", n), "sl": p("bitwise_shift_left", n, 2, 8), "lr": p("bitwise_logical_shift_right", n, 2, 8), "ar": p("bitwise_arithmetic_shift_right", n, 2), "ra": p("bitwise_right_shift_arithmetic", n, 2), "dd": p("divide_double", n, F.lit(4)), "fb": p("from_base", F.lower(F.hex(n)), 16),
        "ty": p("typeof", n), "iff": p("is_infinite", u), "pi": r(p("pi")), "e": r(p("e")), "inf": p("is_infinite", p("infinity")), "nan": F.isnan(p("nan")), "ds": p("parse_presto_data_size", F.lit("1kB")).cast("decimal(5,1)"), "wl": r((p("wilson_interval_lower", F.lit(1), F.lit(2), 0.0) + p("wilson_interval_upper", F.lit(1), F.lit(2), 0.0)) / 2),
        "rn": (p("rand") >= 0) & (p("secure_rand") < 1) & (p("secure_random") < 1), "rr": (drawn >= 0) & (drawn < 10), "tr": p("try", n + 1),
    })


@query(r"""select c_custkey k, ltrim('  ' || s) lt, rtrim(s || '  ') rt, substr(s, 3) sb, levenshtein(s, 'Customer')::bigint lv, replace(s, 'Customer', 'C') rf, replace(s, 'Customer', 'C') rg, length(s) - instr(reverse(s), '0') + 1 sp, regexp_extract_all(s, '[0-9]') ra, string_split(s, '#') rs, ['a', 'b'] sm, ['1', '3'] mm,
url_decode(url_encode(s)) ud, md5(s) md, sha1(s) s1, upper(hex(encode(s))) hx, s fb, s fu, s b64, s bu, lower(hex(encode(s))) nf, 4243 po, 'é' nz, crc cr from (select c_custkey, c_name s, 3421780262 crc from customer)""")
def strings(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("s"))
    t = F.col("s")
    raw = p("to_utf8", t)
    return _cols(c, ["k"], {
        "lt": p("ltrim", F.concat(F.lit(" \t"), t)), "rt": p("rtrim", F.concat(t, F.lit("\n "))), "sb": p("substring", t, 3), "lv": _b(p("levenshtein", t, F.lit("Customer"))), "rf": p("replace_first", t, "Customer", "C"), "rg": p("replacefirst", t, "Customer", "C"), "sp": p("strrpos", t, "0"),
        "ra": p("regexp_extract_all", t, "[0-9]"), "rs": p("regexp_split", t, "#"), "sm": F.map_keys(p("split_to_map", F.lit("a=1,b=2"), ",", "=")), "mm": F.element_at(p("split_to_multimap", F.lit("a=1,b=2,a=3"), ",", "="), "a"), "ud": p("url_decode", p("url_encode", t)), "md": F.lower(F.hex(p("md5", raw))),
        "s1": F.lower(F.hex(p("sha1", raw))), "hx": p("to_hex", raw), "fb": p("from_hex", p("to_hex", raw)).cast("string"), "fu": p("from_utf8", raw), "b64": p("from_base64", p("to_base64", raw)).cast("string"), "bu": p("from_base64url", p("to_base64url", raw)).cast("string"), "nf": F.lower(p("to_hex", raw)),
        "po": p("url_extract_port", F.lit("http://a.b:4243/x")), "nz": p("normalize", F.lit("é")), "cr": p("crc32", F.lit("123456789").cast("binary")),
    })


@query("""select o_orderkey k, o_orderkey b8, (o_orderkey % 1000)::int b4, o_totalprice d8, o_orderkey::float::double d4, 64::bigint l5, 16::bigint m5, 20::bigint n1, 32::bigint n2, 8::bigint xx, 'ef46db3751d8e999' x0, true hm, '6c1b07bc7bbc4be347939ac4a93c437a' mm from orders""")
def bytes_(spark, d):
    o = _t(spark, d, "orders")
    n, key = F.col("o_orderkey"), F.lit("key").cast("binary")
    raw = p("to_big_endian_64", n)
    return _cols(o, [n.alias("k")], {
        "b8": p("from_big_endian_64", raw), "b4": p("from_big_endian_32", p("to_big_endian_32", n % 1000)), "d8": p("from_ieee754_64", p("to_ieee754_64", "o_totalprice")), "d4": p("from_ieee754_32", p("to_ieee754_32", n.cast("float"))).cast("double"), "l5": _b(F.octet_length(p("sha512", raw))),
        "m5": _b(F.octet_length(p("hmac_md5", raw, key))), "n1": _b(F.octet_length(p("hmac_sha1", raw, key))), "n2": _b(F.octet_length(p("hmac_sha256", raw, key))), "xx": _b(F.octet_length(p("xxhash64", raw))), "x0": F.lower(F.hex(p("xxhash64", F.lit(b"")))), "hm": F.octet_length(p("hmac_sha512", raw, key)) == 64,
        "mm": F.lower(F.hex(p("murmur3_x64_128", F.lit(b"The quick brown fox jumps over the lazy dog")))),
    })


@query("""select event_id k, date_trunc('week', ts) tw, date_trunc('month', ts)::date td, day(ts)::bigint dm, isodow(ts)::bigint dw, dayofyear(ts)::bigint dy, week(ts)::bigint wy, isoyear(ts)::bigint yw, strftime(ts, '%Y-%m-%d %H:%M') fd, to_timestamp(event_id)::timestamp fu, strptime(strftime(ts, '%Y-%m-%d'), '%Y-%m-%d') dp,
strptime(strftime(ts, '%Y-%m-%d'), '%Y-%m-%d') pd, ts::date fi, date_trunc('second', ts) ft, 90061000::bigint ms, true cd, 5::bigint tz, 30::bigint tm, ts + interval 2 hour az from events""")
def dates(spark, d):
    e, t, ntz = _t(spark, d, "events"), F.col("ts"), "timestamp_ntz"
    z = t.cast("timestamp")
    return _cols(e, [F.col("event_id").alias("k")], {
        "tw": p("date_trunc", "week", t).cast(ntz), "td": p("date_trunc", "month", t.cast("date"), date=True), "dm": _b(p("day_of_month", t)), "dw": _b(p("day_of_week", t)), "dy": _b(p("day_of_year", t)), "wy": _b(p("week_of_year", t)), "yw": _b(p("year_of_week", t)), "fd": p("format_datetime", t, "YYYY-MM-dd HH:mm"),
        "fu": p("from_unixtime", F.col("event_id")).cast(ntz), "dp": p("date_parse", F.date_format(t, "yyyy-MM-dd"), "%Y-%m-%d").cast(ntz), "pd": p("parse_datetime", F.date_format(t, "yyyy-MM-dd"), "YYYY-MM-dd").cast(ntz), "fi": p("from_iso8601_date", F.date_format(t, "yyyy-MM-dd")),
        "ft": p("from_iso8601_timestamp", F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).cast(ntz), "ms": p("to_milliseconds", F.expr("interval '1 01:01:01' day to second")), "cd": p("current_date").isNotNull() & p("localtime").isNotNull() & (p("parse_duration", F.lit("1.5s")).isNotNull()),
        "tz": _b(p("timezone_hour", z, "Asia/Kolkata")), "tm": _b(p("timezone_minute", z, "Asia/Kolkata")), "az": p("at_timezone", z, "Etc/GMT-2").cast(ntz),
    })


@query("""select event_id k, '[1,2]' ex, '2' ag, true ac, false an, 3::bigint al, '{"x":' || event_id || '}' fo, 6::bigint ta, ['a'] tm, event_id tr, 'on' ek, 2::bigint jp from events""")
def json(spark, d):
    e, i = _t(spark, d, "events"), F.col("event_id")
    return _cols(e, [i.alias("k")], {
        "ex": p("json_extract", F.lit('{"a":[1,2]}'), "$.a"), "ag": p("json_array_get", F.lit("[1,2,3]"), 1), "ac": p("json_array_contains", F.lit("[1,2,3]"), 2), "an": p("json_array_contains", F.lit("[1,2,3]"), 9), "al": _b(p("json_array_length", F.lit("[1,2,3]"))), "fo": p("json_format", F.struct(i.alias("x"))),
        "ta": F.aggregate(p("json_string_to_array_cast", F.lit("[1,2,3]"), "bigint"), F.lit(0).cast("bigint"), lambda s, x: s + x), "tm": F.map_keys(p("json_string_to_map_cast", F.lit('{"a":1}'), "string", "int")), "tr": p("json_string_to_row_cast", F.concat(F.lit('{"x":'), i.cast("string"), F.lit("}")), "x bigint")["x"],
        "ek": p("enum_key", F.lit(1), {"on": 1, "off": 0}), "jp": F.variant_get(p("json_parse", F.lit('{"a":2}')), "$.a", "bigint"),
    })


_SIDES = "select c_custkey k, (c_custkey % 50)::double x, (c_nationkey + 1)::double y from customer"


@query(f"""select k, x * y a, 2 * (x + y) + 0.0 l, x / 2 cx, y / 2 cy, 0.0::double x0, x x1, 0.0::double y0, y y1, x / 4 > 0 ic, true iw, true ii, false dj, false eq, x + 5 ds, 'ST_Polygon' ty, false cl, false em, true rg, true sm, true va, true iv, 5 np, 1 ng, 0 nr, 2 dm, 2 cd, 1 gn, 0 dn, 4 pts, 0.0::double sx, 1 gs, true ov, true tc, false cr, x + 2 ex,
5 ch, x px, y py, 'LINESTRING (0 0, ' || x::int || ' 0)' nw, 0.5 ll, x / 2 li from ({_SIDES}) where x > 0""")
def shapes(spark, d):
    """Rectangles of sides x and y from the origin."""
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 50).cast("double").alias("x"), (F.col("c_nationkey") + 1).cast("double").alias("y")).where("x > 0")
    c = _spread(c)
    text = F.format_string("POLYGON ((0 0, %.1f 0, %.1f %.1f, 0 %.1f, 0 0))", "x", "x", "y", "y")
    moved = F.format_string("POLYGON ((%.2f 0, %.1f 0, %.1f %.1f, %.2f %.1f, %.2f 0))", F.col("x") / 2, F.col("x") + 5, F.col("x") + 5, "y", F.col("x") / 2, "y", F.col("x") / 2)
    beside = F.format_string("POLYGON ((%.1f 0, %.1f 0, %.1f %.1f, %.1f %.1f, %.1f 0))", "x", F.col("x") + 5, F.col("x") + 5, "y", "x", "y", "x")
    c = c.select("*", p("ST_Polygon", text).alias("g"), p("ST_GeometryFromText", moved).alias("m"), p("ST_GeometryFromText", beside).alias("n"))
    g, point = F.col("g"), p("ST_Point", F.col("x") / 4, F.col("y") / 4)
    line = p("ST_LineFromText", F.format_string("LINESTRING (0 0, %.0f 0)", "x"))
    ring = p("ST_ExteriorRing", g)
    mid = p("ST_Centroid", g)
    return _cols(c, ["k"], {
        "a": p("ST_Area", g), "l": p("ST_Length", p("ST_Boundary", g)), "cx": p("ST_X", mid), "cy": p("ST_Y", mid), "x0": p("ST_XMin", g), "x1": p("ST_XMax", g), "y0": p("ST_YMin", g), "y1": p("ST_YMax", g), "ic": p("ST_Contains", g, point), "iw": p("ST_Within", point, g), "ii": p("ST_Intersects", g, point),
        "dj": p("ST_Disjoint", g, point), "eq": p("ST_Equals", g, "m"), "ds": p("ST_Distance", p("ST_Point", F.lit(-5.0), F.lit(0.0)), p("ST_Point", "x", F.lit(0.0))), "ty": p("ST_GeometryType", g), "cl": p("ST_IsClosed", line), "em": p("ST_IsEmpty", g), "rg": p("ST_IsRing", ring), "sm": p("ST_IsSimple", g),
        "va": p("ST_IsValid", g), "iv": p("geometry_invalid_reason", g).isNull(), "np": p("ST_NumPoints", g), "ng": p("ST_NumGeometries", g), "nr": p("ST_NumInteriorRing", g), "dm": p("ST_Dimension", g), "cd": p("ST_CoordDim", g), "gn": p("ST_NumGeometries", p("ST_GeometryN", g, 1)), "dn": p("ST_Dimension", p("ST_StartPoint", line)),
        "pts": F.size(p("ST_Points", g)) - 1, "sx": p("ST_X", p("ST_PointN", ring, 1)), "gs": F.size(p("ST_Geometries", g)), "ov": p("ST_Overlaps", g, "m"), "tc": p("ST_Touches", g, "n"), "cr": p("ST_Crosses", line, g), "ex": p("ST_XMax", p("expand_envelope", g, F.lit(2.0))), "ch": p("ST_NumPoints", p("ST_ConvexHull", g)),
        "px": p("ST_X", p("ST_EndPoint", line)), "py": p("ST_YMax", p("ST_Envelope", p("ST_GeomFromBinary", p("ST_AsBinary", g)))), "nw": p("ST_AsText", p("geometry_from_geojson", p("geometry_as_geojson", line))), "ll": p("line_locate_point", line, p("ST_Point", F.col("x") / 2, F.lit(1.0))).cast("decimal(2,1)"),
        "li": p("ST_X", p("line_interpolate_point", line, F.lit(0.5))),
    })


@query("""select event_id k, z zoom, x tx, y ty, z - 1 pz, 4::bigint nc, z::bigint ql, true same, x // 2 px, 1::bigint ar from (select event_id, (event_id % 10 + 2)::bigint z, event_id % 4 x, event_id % 3 y from events)""")
def tiles(spark, d):
    e = _t(spark, d, "events").select(F.col("event_id").alias("k"), (F.col("event_id") % 10 + 2).alias("z"), (F.col("event_id") % 4).alias("x"), (F.col("event_id") % 3).alias("y"))
    tile = p("bing_tile", F.col("x"), F.col("y"), F.col("z"))
    at = p("bing_tile_at", F.lit(47.6), F.lit(-122.3), F.lit(3))
    return _cols(e.withColumn("t", tile), ["k"], {
        "zoom": _b(p("bing_tile_zoom_level", "t")), "tx": _b(p("bing_tile_coordinates", "t")["x"]), "ty": _b(p("bing_tile_coordinates", "t")["y"]), "pz": _b(p("bing_tile_zoom_level", p("bing_tile_parent", "t"))), "nc": _b(F.size(p("bing_tile_children", "t"))), "ql": _b(F.length(p("bing_tile_quadkey", "t"))),
        "same": p("bing_tile_from_quadkey", p("bing_tile_quadkey", "t")) == F.col("t"), "px": _b(p("bing_tile_coordinates", p("bing_tile_parent", "t"))["x"]), "ar": _b(p("bing_tile_coordinates", at)["x"]),
    })


@query("""select e.event_id k, '10.0.' || (e.event_id % 200) || '.0/24' px, '10.0.' || (e.event_id % 200) || '.0' lo, '10.0.' || (e.event_id % 200) || '.255' hi, 2::bigint rg, true isn, 4::bigint su, 1::bigint cl, true pv from events e""")
def addresses(spark, d):
    e = _t(spark, d, "events")
    ip = F.concat(F.lit("10.0."), (F.col("event_id") % 200).cast("string"), F.lit("."), (F.col("event_id") % 100).cast("string"))
    net = p("ip_prefix", ip, 24)
    halves = F.array(F.concat(p("ip_subnet_min", net), F.lit("/25")), F.concat(F.regexp_replace(p("ip_subnet_min", net), r"\.0$", ".128"), F.lit("/25")))
    return _cols(e, [F.col("event_id").alias("k")], {
        "px": net, "lo": p("ip_subnet_min", net), "hi": p("ip_subnet_max", net), "rg": _b(F.size(p("ip_subnet_range", net))), "isn": p("is_subnet_of", net, ip), "su": _b(F.size(p("ip_prefix_subnets", net, 26))), "cl": _b(F.size(p("ip_prefix_collapse", halves))), "pv": p("is_private_ip", ip),
    })


@query("""select k, round(1 - exp(-x / 2), 8) c2, round(1 - exp(-x / 3), 8) ga, round(u, 8) be, round(x / (1 + x), 8) f, round(exp(-x), 8) po, round(pow(1 - u, 2), 8) bi, 1.0 nm, round(x, 6) ni, round(x, 6) ci, round(x, 6) gi, round(u, 6) bv, round(x, 5) fi, 0 pi0, 0 bi0, round(0.5 + atan(x) / pi(), 9) ca, round(x, 6) cai,
round(1 - 0.5 * exp(-x), 9) la, round(x, 6) lai, round(1 - exp(-pow(x / 2, 3)), 9) we, round(x, 6) wei from (select o_orderkey k, (o_orderkey % 40) / 20.0::double + 0.1 x, (o_orderkey % 90) / 100.0::double + 0.05 u from orders)""")
def probability(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), ((F.col("o_orderkey") % 40) / F.lit(20.0) + 0.1).alias("x"), ((F.col("o_orderkey") % 90) / F.lit(100.0) + 0.05).alias("u"))
    x, u, one, r = F.col("x"), F.col("u"), F.lit(1.0), F.round
    two, three, zero = F.lit(2.0), F.lit(3.0), F.lit(0.0)
    return _cols(o, ["k"], {
        "c2": r(p("chi_squared_cdf", two, x), 8), "ga": r(p("gamma_cdf", one, three, x), 8), "be": r(p("beta_cdf", one, one, u), 8), "f": r(p("f_cdf", two, two, x), 8), "po": r(p("poisson_cdf", x, zero), 8), "bi": r(p("binomial_cdf", two, u, zero), 8),
        "nm": r(p("normal_cdf", zero, one, x) + p("normal_cdf", zero, one, -x), 9).cast("decimal(2,1)"), "ni": r(p("inverse_normal_cdf", zero, one, p("normal_cdf", zero, one, x)), 6), "ci": r(p("inverse_chi_squared_cdf", three, p("chi_squared_cdf", three, x)), 6),
        "gi": r(p("inverse_gamma_cdf", two, three, p("gamma_cdf", two, three, x)), 6), "bv": r(p("inverse_beta_cdf", two, three, p("beta_cdf", two, three, u)), 6), "fi": r(p("inverse_f_cdf", two, three, p("f_cdf", two, three, x)), 5), "pi0": p("inverse_poisson_cdf", x, F.lit(0.01)), "bi0": p("inverse_binomial_cdf", two, F.lit(0.1), F.lit(0.5)),
        "ca": r(p("cauchy_cdf", 0.0, 1.0, x), 9), "cai": r(p("inverse_cauchy_cdf", 0.0, 1.0, p("cauchy_cdf", 0.0, 1.0, x)), 6), "la": r(p("laplace_cdf", 0.0, 1.0, x), 9), "lai": r(p("inverse_laplace_cdf", 0.0, 1.0, p("laplace_cdf", 0.0, 1.0, x)), 6), "we": r(p("weibull_cdf", 3.0, 2.0, x), 9),
        "wei": r(p("inverse_weibull_cdf", 3.0, 2.0, p("weibull_cdf", 3.0, 2.0, x)), 6),
    })


@query("""select l_returnflag g, sum(l_quantity) su, min(l_tax) mn, round(var_samp(l_quantity), 6) va, round(var_samp(l_quantity), 6) vs, round(stddev_pop(l_quantity), 6) sp, round(stddev_samp(l_quantity), 6) ss, bool_and(l_quantity > 0) ev, 1 ar, 1 av, round(regr_avgy(l_extendedprice, l_quantity), 4) ry, round(regr_sxy(l_extendedprice, l_quantity), 1) rxy,
round(regr_syy(l_extendedprice, l_quantity), 0) ryy, arg_max(l_orderkey, l_extendedprice) xb, count(*) aa, list_sort(list(distinct l_linenumber)) su2, map_from_entries(list_transform(list_sort(list(distinct l_linenumber)), lambda x: (x, x))) ma, count(*) mu, sum(octet_length(encode(l_returnflag)))::bigint sd, 1::bigint md,
sum(l_linenumber)::bigint ra, true ck, true ad, round(sum(pow(l_quantity - m, 3)) / count(*) / pow(sum(pow(l_quantity - m, 2)) / count(*), 1.5), 6) sk, true ku, true ap, quantile_disc(l_linenumber, 0.5)::bigint pw, count(*) hi, true hl, true nh, true mf, list_reverse_sort(list(l_linenumber))[1:2] mx2, list_sort(list(l_linenumber))[1:2] mn2 from (select *, avg(l_quantity) over (partition by l_returnflag) m from lineitem) group by 1""")
def aggregates(spark, d):
    """What gathers values comes from counts or parts of a group, and distinct orders are counted apart, so that no task holds a group."""
    r, c, q = F.round, F.col("l_linenumber"), F.col("l_quantity")
    li = _t(spark, d, "lineitem").withColumnRenamed("l_returnflag", "g")
    one = F.lit(1)
    sort_map = lambda m: F.map_from_arrays(F.array_sort(F.map_keys(m)), F.array_sort(F.map_values(m)))
    # of rows of one price the first order
    top = F.when(F.col("l_extendedprice").isNotNull(), F.struct(F.col("l_extendedprice"), -F.col("l_orderkey")))
    aggs = {
        "su": p("sum", "l_quantity"), "mn": p("min", "l_tax"), "va": r(p("variance", "l_quantity"), 6), "vs": r(p("var_samp", "l_quantity"), 6), "sp": r(p("stddev_pop", "l_quantity"), 6), "ss": r(p("stddev_samp", "l_quantity"), 6), "ev": p("every", q > 0), "ar": p("arbitrary", one), "av": p("any_value", one),
        "ry": r(p("regr_avgy", "l_extendedprice", "l_quantity"), 4), "rxy": r(p("regr_sxy", "l_extendedprice", "l_quantity"), 1), "ryy": r(p("regr_syy", "l_extendedprice", "l_quantity"), 0), "xb": p("max_by", "l_orderkey", top),
        "sd": p("sum_data_size_for_stats", "g"), "md": p("max_data_size_for_stats", "g"), "ck": p("checksum", "l_orderkey").isNotNull(), "ad": p("approx_distinct", "l_orderkey"), "sk": r(p("skewness", "l_quantity"), 6), "ku": p("kurtosis", "l_quantity") < 0,
        "ap": F.abs(p("approx_percentile", q, 0.5) - F.percentile(q, 0.5)) <= 1, "pw": _b(F.floor(p("approx_percentile", c, 0.5, weight=F.lit(3)))), "hl": p("cardinality_hll", p("approx_set", "l_orderkey")), "nh": F.size(p("numeric_histogram", q, F.lit(5))) <= 5,
        "mf": F.size(p("approx_most_frequent", 3, "l_linenumber")) == 3, "mx2": p("max", "l_linenumber", 2), "mn2": p("min", "l_linenumber", 2),
    }
    sizes = F.aggregate(F.map_values(p("multimap_agg", c, c)), F.lit(0), lambda s, x: s + F.size(x))
    add = lambda s, x: s + x
    found = li.groupBy("g").agg(*[v.alias(k) for k, v in aggs.items()])
    for more in (
        li.select("g", "l_orderkey").where("l_orderkey is not null").distinct().groupBy("g").agg(F.count(one).alias("orders")),
        A.in_parts(li, ["g"], {"aa": F.size(p("array_agg", c)), "mu": sizes}, {"aa": _b(F.sum("aa")), "mu": _b(F.sum("mu"))}),
        A.reduces(li.select("g", _b(c).alias("c")), ["g"], "c", F.lit(0).cast("bigint"), add, add, "ra"),
        li.select("g", c).distinct().groupBy("g").agg(F.array_sort(p("set_union", F.array(c))).alias("su2"), sort_map(p("map_agg", c, c)).alias("ma")),
        A.histograms(li, ["g"], "l_linenumber").select("g", F.aggregate(F.map_values("histogram"), F.lit(0).cast("bigint"), add).alias("hi")),
    ):
        found = found.join(more.withColumnRenamed("g", "__g"), F.col("g").eqNullSafe(F.col("__g")), "left").drop("__g")
    close = lambda n: F.abs(F.col(n) / F.col("orders") - 1) < 0.1
    order = "su mn va vs sp ss ev ar av ry rxy ryy xb aa su2 ma mu sd md ra ck ad sk ku ap pw hi hl nh mf mx2 mn2"
    return found.withColumns({"ad": close("ad"), "hl": close("hl"), "hi": F.coalesce("hi", F.lit(0))}).select("g", *order.split())


@query("""select k, 5.0::double vq, 0.5::double qv, 5.0::double tm, 0.0::double mn, 10.0::double mx, 4::bigint n, 8::bigint sn, 8::bigint mg from (select c_custkey k from customer)""")
def digests(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    arr = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    g = p("construct_tdigest", arr(2, 4, 6, 8), arr(1, 1, 1, 1), F.lit(0.0), F.lit(10.0))
    out = p("destructure_tdigest", g)
    return _cols(c, ["k"], {
        "vq": p("value_at_quantile_digest", g, 0.5), "qv": F.get(p("quantiles_at_values_digest", g, arr(5.0)), F.lit(0)), "tm": p("trimmed_mean", g, 0.25, 0.75), "mn": out["min"], "mx": out["max"], "n": out["count"], "sn": p("destructure_tdigest", p("scale_tdigest", g, F.lit(2.0)))["count"],
        "mg": p("destructure_tdigest", p("merge_tdigest", F.array(g, g)))["count"],
    })


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"ansi_{k.rstrip('_')}": f for k, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {f"ansi_{k.rstrip('_')}": v for k, v in SQL.items()}
