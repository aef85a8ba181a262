"""Queries that apply groups of functions to whole tables."""

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


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _cols(df: DataFrame, keys: list[str], cols: dict) -> DataFrame:
    return df.select(*keys, *[c.alias(n) for n, c in cols.items()])


_ARR = "select o_orderkey k, [o_orderkey % 7, o_custkey % 5, null, o_orderkey % 7, 3] a, [o_orderkey % 4, o_custkey % 3, 2] b from orders"


def _arr(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.expr("array(o_orderkey % 7, o_custkey % 5, null, o_orderkey % 7, 3L)").alias("a"), F.expr("array(o_orderkey % 4, o_custkey % 3, 2L)").alias("b"))


@query(f"""select k, list_min(b) b_min, list_max(b) b_max, null::bigint a_min, len(list_distinct(b)) < 3 dup, len(list_filter(a, lambda x: x is not null))::bigint n_some, list_sum(a)::bigint total,
list_contains(b, 2) has2, list_filter(b, lambda x: x <> 2) no2, list_sort(list_distinct(b || [9])) uni, list_filter(b, lambda x: x > 1)[1] first_big, list_avg(b) mean, b[4] beyond, list_reverse_sort(b)[1:2] top2,
list_transform([1, 2, 3], lambda i: list_sum(b[1:i])::bigint) cum, b[1:2] trimmed, list_has_any(a, b) overlap, not list_bool_or(list_transform(b, lambda x: x > 3)) none_big,
list_aggregate(list_transform(b, lambda x: x * x), 'sum')::bigint sq, [b[1:2], b[2:3]] grams, coalesce(list_position(b, 2), 0)::bigint pos from ({_ARR})""")
def arrays(spark, d):
    x = lambda n, *a, **o: p(n, *a, **o)
    return _cols(_arr(spark, d), ["k"], {
        "b_min": x("array_min", "b"), "b_max": x("array_max", "b"), "a_min": x("array_min", "a"), "dup": x("array_has_duplicates", "b"), "n_some": x("cardinality", x("remove_nulls", "a")), "total": x("array_sum", "a"),
        "has2": x("contains", "b", 2), "no2": x("array_remove", "b", 2), "uni": F.array_sort(x("array_union", "b", F.array(F.lit(9).cast("bigint")))), "first_big": x("find_first", "b", lambda v: v > 1),
        "mean": x("array_average", "b"), "beyond": x("element_at", "b", 4), "top2": x("array_top_n", "b", 2), "cum": x("array_cum_sum", "b"), "trimmed": x("trim_array", "b", 1), "overlap": F.coalesce(x("arrays_overlap", "a", "b"), F.lit(False)),
        "none_big": x("none_match", "b", lambda v: v > 3), "sq": x("reduce", "b", F.lit(0).cast("bigint"), lambda s, v: s + v * v), "grams": x("ngrams", "b", 2), "pos": x("array_position", "b", 2),
    })


@query(f"""select k, map_keys(m) ks, map_values(m) vs, cardinality(m)::bigint n, map_extract(m, 'x')[1] vx, map_contains(m, 'y') has_y, list_sort(list_filter(map_keys(m), lambda q: m[q] > 2)) big_keys from
(select o_orderkey k, map {{'x': o_orderkey % 5, 'y': o_custkey % 4}} m from orders)""")
def maps(spark, d):
    m = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.expr("map('x', o_orderkey % 5, 'y', o_custkey % 4)").alias("m"))
    return _cols(m, ["k"], {"ks": p("map_keys", "m"), "vs": p("map_values", "m"), "n": p("cardinality", "m"), "vx": p("element_at", "m", "x"), "has_y": p("map_key_exists", "m", "y"), "big_keys": F.array_sort(p("map_keys", p("map_filter", "m", lambda _, v: v > 2)))})


@query("""select o_orderkey k, abs(x) ax, ceil(x / 7)::bigint up, floor(x / 7)::bigint down, round(x / 7, 2) rnd, trunc(x / 7) cut, sqrt(abs(x)) sq, round(cbrt(x), 9) cb, round(ln(abs(x) + 1), 9) l, round(log2(abs(x) + 1), 9) l2, round(log10(abs(x) + 1), 9) l10,
round(exp(x / 1000000), 9) ex, round(pow(x / 100, 2), 4) pw, sign(x)::double sg, least(greatest(x, -10), 10) cl, round(sin(x), 9) si, round(cos(x), 9) co, round(tan(x / 100), 9) ta, round(atan2(x, 3), 9) a2, round(radians(x / 1000), 9) ra, round(degrees(x / 1000), 6) de,
isnan(x) nan, isfinite(x) fin, n % 7 md, n // 3 dv, (n & 12) ba, (n | 3) bo, xor(n, 5) bx, (n << 3) sl, (n >> 2) sr, bit_count(n)::bigint bc, lower(to_base(n, 16)) hx, case when n between 10 and 20 then 1 else 0 end btw, null is distinct from n df
from (select o_orderkey, o_totalprice - 200000 x, o_orderkey n from orders)""")
def math(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") - 200000).alias("x"), F.col("o_orderkey").alias("n"))
    x, n = F.col("x"), F.col("n")
    r = F.round
    return _cols(o, ["k"], {
        "ax": p("abs", x), "up": p("ceil", x / 7), "down": p("floor", x / 7), "rnd": p("round", x / 7, 2), "cut": p("truncate", x / 7), "sq": p("sqrt", F.abs(x)), "cb": r(p("cbrt", x), 9), "l": r(p("ln", F.abs(x) + 1), 9),
        "l2": r(p("log2", F.abs(x) + 1), 9), "l10": r(p("log10", F.abs(x) + 1), 9), "ex": r(p("exp", x / 1000000), 9), "pw": r(p("pow", x / 100, F.lit(2)), 4), "sg": p("sign", x), "cl": p("clamp", x, -10.0, 10.0), "si": r(p("sin", x), 9),
        "co": r(p("cos", x), 9), "ta": r(p("tan", x / 100), 9), "a2": r(p("atan2", x, F.lit(3)), 9), "ra": r(p("radians", x / 1000), 9), "de": r(p("degrees", x / 1000), 6), "nan": p("is_nan", x), "fin": p("is_finite", x), "md": p("mod", n, 7),
        "dv": p("divide", n, 3), "ba": p("bitwise_and", n, 12), "bo": p("bitwise_or", n, 3), "bx": p("bitwise_xor", n, 5), "sl": p("bitwise_left_shift", n, 3), "sr": p("bitwise_right_shift", n, 2), "bc": p("bit_count", n),
        "hx": p("to_base", n, 16), "btw": F.when(p("between", n, 10, 20), 1).otherwise(0), "df": p("distinct_from", F.lit(None).cast("bigint"), n),
    })


@query(r"""select c_custkey k, upper(s) up, lower(s) lo, length(s) n, reverse(s) rv, substr(s, 3, 4) sub, split_part(s, '#', 2) part, replace(s, '0', '-') rep, strpos(s, '0')::bigint pos, starts_with(s, 'Cust') st, ends_with(s, '7') en, contains(s, '00') ct,
lpad(s, 24, '*') lp, rpad(s, 24, '*') rp, trim('  ' || s || ' ') tr, regexp_matches(s, '[0-9]{3}5') rl, regexp_extract(s, '([0-9]+)', 1) re, regexp_replace(s, '[A-Z]', '_', 'g') rr, levenshtein(s, 'Customer')::int lv, s || '!' cc, right(s, 3) tl,
string_split(s, '0') sp, md5(s) md, sha256(s) sh, ascii(s) cp, chr((65 + c_custkey % 26)::int) ch, lower(hex(encode(s))) hx, base64(encode(s)) b64, hamming(s, reverse(s))::bigint hd, s like '%1_' lk, url_encode(s || ' &') ue from (select c_custkey, c_name s from customer)""")
def strings(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("s"))
    s = F.col("s")
    return _cols(c, ["k"], {
        "up": p("upper", s), "lo": p("lower", s), "n": p("length", s).cast("bigint"), "rv": p("reverse", s), "sub": p("substr", s, 3, 4), "part": F.coalesce(p("split_part", s, "#", 2), F.lit("")), "rep": p("replace", s, "0", "-"), "pos": p("strpos", s, "0"),
        "st": p("starts_with", s, F.lit("Cust")), "en": p("ends_with", s, F.lit("7")), "ct": F.contains(s, F.lit("00")), "lp": p("lpad", s, 24, "*"), "rp": p("rpad", s, 24, "*"), "tr": p("trim", F.concat(F.lit("  "), s, F.lit(" "))),
        "rl": p("regexp_like", s, "[0-9]{3}5"), "re": p("regexp_extract", s, "([0-9]+)", 1), "rr": p("regexp_replace", s, "[A-Z]", "_"), "lv": p("levenshtein_distance", s, F.lit("Customer")), "cc": p("concat", s, F.lit("!")), "tl": p("trail", s, 3),
        "sp": p("split", s, "0"), "md": F.md5(s), "sh": F.lower(p("to_hex", p("sha256", s))), "cp": p("codepoint", s), "ch": p("chr", 65 + F.col("k") % 26), "hx": F.lower(p("to_hex", p("to_utf8", s))), "b64": p("to_base64", p("to_utf8", s)),
        "hd": p("hamming_distance", s, F.reverse(s)), "lk": p("like", s, "%1_"), "ue": F.regexp_replace(p("url_encode", F.concat(s, F.lit(" &"))), r"\+", "%20"),
    })


@query("""select event_id k, year(ts)::bigint y, quarter(ts)::bigint q, month(ts)::bigint m, week(ts)::bigint w, day(ts)::bigint dd, isodow(ts)::bigint dow, dayofyear(ts)::bigint doy, isoyear(ts)::bigint yow, hour(ts)::bigint h, minute(ts)::bigint mi, second(ts)::bigint s,
(epoch_us(ts) // 1000) % 1000 ms, date_trunc('hour', ts) th, date_trunc('month', ts)::date tm, last_day(ts) ld, strftime(ts, '%Y-%m-%d %H:%M:%S') fm, round(epoch(ts), 3) ep, datesub('day', timestamp '2024-01-01', ts) fullday, ts + interval 3 day plus3, ts::date dt,
datesub('hour', timestamp '2024-01-01', ts) dh, make_date(2024, 1, 1 + (event_id % 28)::int) mk from events""")
def dates(spark, d):
    e, t = _t(spark, d, "events"), F.col("ts")
    big = lambda c: c.cast("bigint")
    zero = F.lit("2024-01-01").cast("timestamp_ntz")
    return _cols(e, [F.col("event_id").alias("k")], {
        "y": big(p("year", t)), "q": big(p("quarter", t)), "m": big(p("month", t)), "w": big(p("week", t)), "dd": big(p("day", t)), "dow": big(p("dow", t)), "doy": big(p("doy", t)), "yow": big(p("yow", t)), "h": big(p("hour", t)), "mi": big(p("minute", t)),
        "s": big(p("second", t)), "ms": p("millisecond", t), "th": F.date_trunc("hour", t).cast("timestamp_ntz"), "tm": F.trunc(t, "month"), "ld": p("last_day_of_month", t), "fm": p("date_format", t, "%Y-%m-%d %H:%i:%s"), "ep": F.round(p("to_unixtime", t), 3),
        "fullday": p("date_diff", "DAY", zero, t), "plus3": p("date_add", "DAY", 3, t), "dt": p("date", t), "dh": p("date_diff", "HOUR", zero, t), "mk": F.make_date(F.lit(2024), F.lit(1), (1 + F.col("event_id") % 28).cast("int")),
    })


@query("""select event_id k, props->>'$.k' v, json_valid(props) ok, json_array_length('[1, 2, ' || event_id || ']')::bigint n from events""")
def json(spark, d):
    e = _t(spark, d, "events")
    arr = F.concat(F.lit("[1, 2, "), F.col("event_id").cast("string"), F.lit("]"))
    return _cols(e, [F.col("event_id").alias("k")], {"v": p("json_extract_scalar", "props", "$.k"), "ok": ~p("is_json_scalar", "props"), "n": p("json_size", arr)})


@query("""select page_id k, regexp_extract(url, '://([^/:?#]+)', 1) host, regexp_extract(url, '^([a-z]+):', 1) proto, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') page, nullif(regexp_extract(url, '#(.*)$', 1), '') frag,
nullif(regexp_extract(url, '\\?([^#]*)', 1), '') q, regexp_extract(url, '://[^/]+(/[^?#]*)', 1) path from pages""".replace("\\\\", "\\"))
def urls(spark, d):
    u = F.col("url")
    return _cols(_t(spark, d, "pages"), [F.col("page_id").alias("k")], {"host": p("url_extract_host", u), "proto": p("url_extract_protocol", u), "page": p("url_extract_parameter", u, "page"), "frag": p("url_extract_fragment", u), "q": p("url_extract_query", u), "path": p("url_extract_path", u)})


@query("""select l_returnflag g, count(*) n, avg(l_quantity) a, bit_or(l_orderkey) bo, bit_and(l_orderkey) ba, bit_xor(l_orderkey) bx, bool_and(l_quantity > 0) al, bool_or(l_quantity > 49) an, count(*) filter (l_tax > 0.04) ci,
round(covar_pop(l_quantity, l_tax), 8) cp, round(covar_samp(l_quantity, l_tax), 8) cs, round(corr(l_quantity, l_extendedprice), 8) co, round(regr_slope(l_extendedprice, l_quantity), 6) sl, round(regr_intercept(l_extendedprice, l_quantity), 4) ic,
round(regr_r2(l_extendedprice, l_quantity), 8) r2, regr_count(l_extendedprice, l_quantity)::bigint rc, round(regr_sxx(l_extendedprice, l_quantity), 2) sxx, round(regr_avgx(l_extendedprice, l_quantity), 6) ax, round(stddev_samp(l_quantity), 8) sd, round(var_pop(l_quantity), 6) vp,
round(exp(avg(ln(l_quantity))), 8) gm, arg_min(l_orderkey, l_extendedprice) mb, max(l_extendedprice) mx, list_reverse_sort(list(l_linenumber))[1:3] top3, list_sort(list(distinct l_linenumber)) sset from lineitem group by 1""")
def aggregate_functions(spark, d):
    r = F.round
    aggs = {
        "n": p("count", F.lit(1)), "a": p("avg", "l_quantity"), "bo": p("bitwise_or_agg", "l_orderkey"), "ba": p("bitwise_and_agg", "l_orderkey"), "bx": p("bitwise_xor_agg", "l_orderkey"), "al": p("bool_and", F.col("l_quantity") > 0), "an": p("bool_or", F.col("l_quantity") > 49),
        "ci": p("count_if", F.col("l_tax") > 0.04), "cp": r(p("covar_pop", "l_quantity", "l_tax"), 8), "cs": r(p("covar_samp", "l_quantity", "l_tax"), 8), "co": r(p("corr", "l_quantity", "l_extendedprice"), 8),
        "sl": r(p("regr_slope", "l_extendedprice", "l_quantity"), 6), "ic": r(p("regr_intercept", "l_extendedprice", "l_quantity"), 4), "r2": r(p("regr_r2", "l_extendedprice", "l_quantity"), 8), "rc": p("regr_count", "l_extendedprice", "l_quantity"),
        "sxx": r(p("regr_sxx", "l_extendedprice", "l_quantity"), 2), "ax": r(p("regr_avgx", "l_extendedprice", "l_quantity"), 6), "sd": r(p("stddev", "l_quantity"), 8), "vp": r(p("var_pop", "l_quantity"), 6), "gm": r(p("geometric_mean", "l_quantity"), 8),
        "mb": p("min_by", "l_orderkey", "l_extendedprice"), "mx": p("max", "l_extendedprice"), "top3": p("max", "l_linenumber", 3), "sset": F.array_sort(p("set_agg", "l_linenumber")),
    }
    return _t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(*[c.alias(n) for n, c in aggs.items()])


@query("""select event_type g, round(entropy_bits, 9) e, n from (select event_type, -sum(c / t * log2(c / t)) entropy_bits, sum(c)::bigint n from (select event_type, user_id % 10 u, count(*)::double c, sum(count(*)) over (partition by event_type)::double t from events group by 1, 2) group by 1)""")
def entropy_of_counts(spark, d):
    c = _t(spark, d, "events").groupBy("event_type", F.col("user_id") % 10).agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy(F.col("event_type").alias("g")).agg(F.round(p("entropy", "c"), 9).alias("e"), F.sum("c").alias("n"))


@query("""select u, k, n from (select user_id u, event_type k, count(*) n from events group by 1, 2)""")
def histogram(spark, d):
    h = A.histograms(_t(spark, d, "events"), ["user_id"], "event_type")
    return h.select(F.col("user_id").alias("u"), F.explode("histogram").alias("k", "n"))


@query("""with b as (select least(floor(l_discount * 10 * 10), 9)::int b, sum((l_returnflag = 'R')::int)::double t, sum((l_returnflag <> 'R')::int)::double f from lineitem group by 1),
c as (select b, sum(t) over (order by b desc) tp, sum(f) over (order by b desc) fp, sum(t) over () tt, sum(f) over () ff from b)
select (row_number() over (order by b))::bigint i, b / 10 threshold, round(tp / (tp + fp), 9) pr, round(tp / tt, 9) rc, round(fp / ff, 9) fo, round((tt - tp) / tt, 9) mr from c""")
def classification_curves(spark, d):
    x = _t(spark, d, "lineitem").select((F.col("l_returnflag") == "R").alias("y"), (F.col("l_discount") * 10).alias("p"))
    c = A.classification(x, [], 10, "y", "p")
    z = c.select(F.posexplode(F.arrays_zip("thresholds", "precision", "recall", "fall_out", "miss_rate")).alias("i", "s"))
    return z.select((F.col("i") + 1).cast("bigint").alias("i"), F.col("s.thresholds").alias("threshold"), F.round("s.precision", 9).alias("pr"), F.round("s.recall", 9).alias("rc"), F.round("s.fall_out", 9).alias("fo"), F.round("s.miss_rate", 9).alias("mr"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"fn_{k}": f for k, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {f"fn_{k}": s for k, s in SQL.items()}
