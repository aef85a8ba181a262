"""One query per relational operator, over the star schema and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespar import operators as O

from .tpch import _t, _ts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# nulls for tests of null semantics: keys divisible by 10 are null
_CUST = "(select case when c_custkey % 10 = 0 then null else c_custkey end k, c_nationkey, c_acctbal from customer)"
_ORD = "(select case when o_custkey % 7 = 0 then null else o_custkey end ok, o_orderkey, o_totalprice from orders where o_orderkey % 5 = 0)"


def _cust(spark, d):
    return _t(spark, d, "customer").select(F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey")).alias("k"), "c_nationkey", "c_acctbal")


def _ord(spark, d):
    return _t(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("ok"), "o_orderkey", "o_totalprice")


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_shipdate >= timestamp '2000-01-01' and l_quantity > 30 and l_returnflag = 'N'")
def scan_filter(spark, d):
    return _t(spark, d, "lineitem").where((F.col("l_shipdate") >= _ts("2000-01-01")) & (F.col("l_quantity") > 30) & (F.col("l_returnflag") == "N")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("select i, s, x from (values (1, 'a', 1.5::double), (2, null, null), (null, 'c', 0.0::double)) t(i, s, x), range(2) r(n0)")
def values_repeat(spark, d):
    return O.values(spark, [(1, "a", 1.5), (2, None, None), (None, "c", 0.0)], "i int, s string, x double", repeat=2)


@query("select o_orderkey + 1 as k, upper(o_orderpriority) p, case when o_totalprice > 1000 then 'big' else 'small' end size from orders")
def project_exprs(spark, d):
    return O.project(_t(spark, d, "orders"), "o_orderkey + 1 as k", "upper(o_orderpriority) as p", "case when o_totalprice > 1000 then 'big' else 'small' end as size")


@query("select o_orderkey a, o_custkey b, o_totalprice * 2 c from orders where o_orderkey < 1000")
def parallel_project(spark, d):
    return O.parallel_project(_t(spark, d, "orders").where("o_orderkey < 1000"), [["o_orderkey as a"], ["o_custkey as b", "o_totalprice * 2 as c"]])


@query("""select event_type, count(*) n, count(distinct user_id) users, round(sum(value), 4) total, round(sum(value) filter (value > 50), 4) big, min(value) least, max(value) most from events group by 1""")
def aggregate_mask_distinct(spark, d):
    aggs = ["count(*) as n", "count(distinct user_id) as users", "round(sum(value), 4) as total", "round(sum(value) filter (where value > 50), 4) as big", "min(value) as least", "max(value) as most"]
    return O.aggregate(_t(spark, d, "events"), ["event_type"], aggs)


@query("select count(*) n, sum(value) total, max(event_id) top from events where event_id < 0")
def aggregate_global_empty(spark, d):
    return O.aggregate(_t(spark, d, "events").where("event_id < 0"), [], ["count(*) as n", "sum(value) as total", "max(event_id) as top"])


@query("select distinct c_mktsegment, c_nationkey from customer")
def distinct_rows(spark, d):
    return O.aggregate(_t(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], [])


@query("select l_orderkey, count(*) n, round(sum(l_extendedprice), 2) total from lineitem group by 1")
def streaming_aggregate(spark, d):
    return O.streaming_aggregate(_t(spark, d, "lineitem"), ["l_orderkey"], ["count(*) as n", "round(sum(l_extendedprice), 2) as total"])


@query("""select o_orderstatus, o_orderpriority, count(*) n, round(sum(o_totalprice), 2) total, grouping(o_orderstatus, o_orderpriority)::bigint gid from orders group by cube (o_orderstatus, o_orderpriority)""")
def cube(spark, d):
    return _t(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().cast("bigint").alias("gid"))


@query("""select n_regionkey, c_mktsegment, count(*) n from customer join nation on c_nationkey = n_nationkey group by rollup (n_regionkey, c_mktsegment)""")
def rollup(spark, d):
    return _t(spark, d, "customer").join(F.broadcast(_t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).rollup("n_regionkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("""select l_returnflag, null l_linestatus, 0::bigint group_id, round(sum(l_quantity), 2) q from lineitem group by 1 union all select null, l_linestatus, 1, round(sum(l_quantity), 2) from lineitem group by 2
union all select l_returnflag, null, 2, round(sum(l_quantity), 2) from lineitem group by 1""")
def group_id(spark, d):
    x = O.group_id(_t(spark, d, "lineitem"), [["l_returnflag"], ["l_linestatus"], ["l_returnflag"]], ["l_quantity"])
    return x.groupBy("l_returnflag", "l_linestatus", "group_id").agg(F.round(F.sum("l_quantity"), 2).alias("q"))


@query("select c_custkey k, c_acctbal v, 'bal' what from customer union all select c_custkey, c_nationkey, 'nation' from customer")
def expand(spark, d):
    return O.expand(_t(spark, d, "customer"), [["c_custkey", "c_acctbal", F.lit("bal")], ["c_custkey", "cast(c_nationkey as double)", F.lit("nation")]], ["k", "v", "what"])


@query("select event_id, user_id, row_number() over (partition by user_id, event_type order by event_id) = 1 is_first from events")
def mark_distinct(spark, d):
    return O.mark_distinct(_t(spark, d, "events"), ["user_id", "event_type"], "is_first", ["event_id"]).select("event_id", "user_id", "is_first")


@query("select count(*) n, count(distinct n) ids from (select row_number() over () n from orders)")
def assign_unique_id(spark, d):
    return O.assign_unique_id(_t(spark, d, "orders"), "u").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("ids"))


@query("select r_regionkey, r_name from region where r_regionkey = 3 union all select null, null")
def enforce_single_row(spark, d):
    r = _t(spark, d, "region")
    return O.enforce_single_row(r.where("r_regionkey = 3")).unionByName(O.enforce_single_row(r.where("r_regionkey = 99")))


def _join(kind: str, sql: str, **more):
    def f(spark, d):
        return O.hash_join(_cust(spark, d), _ord(spark, d), ["k"], ["ok"], kind, **more)

    f.__name__ = f"join_{kind}" + "".join(f"_{k}" for k in more)
    f.__doc__ = f"Join: {kind} {more or ''}"
    query(sql)(f)


_join("inner", f"select * from {_CUST} join {_ORD} on k = ok")
_join("left", f"select * from {_CUST} left join {_ORD} on k = ok")
_join("right", f"select * from {_CUST} right join {_ORD} on k = ok")
_join("full", f"select * from {_CUST} full join {_ORD} on k = ok")
_join("left", f"select * from {_CUST} left join {_ORD} on k = ok and o_totalprice > c_acctbal * 20", condition="o_totalprice > c_acctbal * 20")
_join("full", f"select * from {_CUST} full join {_ORD} on k = ok and o_totalprice > c_acctbal * 20", condition="o_totalprice > c_acctbal * 20")
_join("left_semi_filter", f"select * from {_CUST} where exists (select 1 from {_ORD} where k = ok)")
_join("right_semi_filter", f"select * from {_ORD} where exists (select 1 from {_CUST} where k = ok)")
_join("left_semi_project", f"select *, coalesce(k in (select ok from {_ORD} where ok is not null), false) as match from {_CUST}")
_join("left_semi_project", f"select *, case when k is null then null when k in (select ok from {_ORD} where ok is not null) then true end as match from {_CUST}", null_aware=True)
_join("left_semi_project", f"select *, exists (select 1 from {_ORD} where k = ok and o_totalprice > c_acctbal * 20) as match from {_CUST}", condition="o_totalprice > c_acctbal * 20")
_join("right_semi_project", f"select *, coalesce(ok in (select k from {_CUST} where k is not null), false) as match from {_ORD}")
_join("left_semi_project", f"""select *, case when exists (select 1 from {_ORD} where k = ok and o_totalprice > c_acctbal * 20) then true
when exists (select 1 from {_ORD} where (k is null or ok is null) and o_totalprice > c_acctbal * 20) then null else false end as match from {_CUST}""", condition="o_totalprice > c_acctbal * 20", null_aware=True)
_join("anti", f"select * from {_CUST} where not exists (select 1 from {_ORD} where k = ok)")
_join("anti", f"select * from {_CUST} where k not in (select ok from {_ORD})", null_aware=True)


@query(f"select * from {_CUST} where k not in (select ok from {_ORD} where ok is not null)")
def join_anti_null_aware_no_null_build(spark, d):
    return O.hash_join(_cust(spark, d), _ord(spark, d).where("ok is not null"), ["k"], ["ok"], "anti", null_aware=True)


@query(f"select * from {_CUST}")
def join_anti_null_aware_empty_build(spark, d):
    return O.hash_join(_cust(spark, d), _ord(spark, d).where("o_orderkey < 0"), ["k"], ["ok"], "anti", null_aware=True)


@query("select o_orderkey, c_custkey, c_name from orders join customer on o_custkey = c_custkey")
def join_merge(spark, d):
    return O.merge_join(_t(spark, d, "orders"), _t(spark, d, "customer"), ["o_custkey"], ["c_custkey"]).select("o_orderkey", "c_custkey", "c_name")


@query("select s_suppkey, n_nationkey from supplier join nation on s_nationkey > n_nationkey + 20")
def join_nested_loop(spark, d):
    return O.nested_loop_join(_t(spark, d, "supplier"), _t(spark, d, "nation"), "s_nationkey > n_nationkey + 20").select("s_suppkey", "n_nationkey")


@query("select s_suppkey, n_nationkey from supplier full join nation on s_nationkey > n_nationkey + 20")
def join_nested_loop_full(spark, d):
    return O.nested_loop_join(_t(spark, d, "supplier"), _t(spark, d, "nation"), "s_nationkey > n_nationkey + 20", "full").select("s_suppkey", "n_nationkey")


@query("select n_nationkey, exists (select 1 from supplier where s_nationkey > n_nationkey + 20) as match from nation")
def join_nested_loop_project(spark, d):
    return O.nested_loop_join(_t(spark, d, "nation"), _t(spark, d, "supplier"), "s_nationkey > n_nationkey + 20", "left_semi_project").select("n_nationkey", "match")


@query("select r_name, n_name from region, nation")
def join_cross(spark, d):
    return O.cross_join(_t(spark, d, "region").select("r_name"), _t(spark, d, "nation").select("n_name"))


@query("select l_orderkey, l_linenumber, o_orderkey is not null as found from lineitem left join orders on l_orderkey = o_orderkey and l_quantity between 10 and 30")
def join_index_lookup(spark, d):
    return O.index_lookup_join(_t(spark, d, "lineitem"), _t(spark, d, "orders"), ["l_orderkey"], ["o_orderkey"], "left", ["l_quantity between 10 and 30"], "found").select("l_orderkey", "l_linenumber", "found")


@query("select o_orderkey, p_partkey from orders join part on o_totalprice between p_retailprice and p_retailprice + 5 where o_orderkey % 20 = 0")
def join_range(spark, d):
    ranges = _t(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + 5).alias("hi"))
    return O.range_join(_t(spark, d, "orders").where("o_orderkey % 20 = 0"), ranges, "o_totalprice", "lo", "hi", 8.0).select("o_orderkey", "p_partkey")


_RANGES = "(select p_partkey, p_retailprice lo, p_retailprice + 5 hi from part)"
_POINTS = "(select o_orderkey, o_totalprice from orders where o_orderkey % 20 = 0)"


def _range(kind: str):
    def f(spark, d):
        ranges = _t(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + 5).alias("hi"))
        return O.range_join(_t(spark, d, "orders").where("o_orderkey % 20 = 0").select("o_orderkey", "o_totalprice"), ranges, "o_totalprice", "lo", "hi", 8.0, kind=kind).select("o_orderkey", "p_partkey")

    f.__name__ = f"join_range_{kind}"
    query(f"select o_orderkey, p_partkey from {_POINTS} {kind} join {_RANGES} on o_totalprice between lo and hi")(f)


for _k in ("left", "right", "full"):
    _range(_k)


@query("""with l as (select event_id, user_id, ts from events where event_type = 'purchase'), r as (select user_id u, ts t, max(value) v from events where event_type = 'view' group by 1, 2)
select event_id, user_id, ts, v asof_v from l asof left join r on user_id = u and ts >= t""")
def join_as_of(spark, d):
    e = _t(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("v"))
    return O.as_of_join(left, right, "ts", "ts", ["user_id"], ["v"])


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def top_n(spark, d):
    return O.top_n(_t(spark, d, "orders"), ["o_totalprice desc", "o_orderkey"], 25).select("o_orderkey", "o_totalprice")


@query("select o_orderkey from (select o_orderkey from orders order by o_orderkey limit 40 offset 13)")
def limit_offset(spark, d):
    return O.limit(O.order_by(_t(spark, d, "orders"), ["o_orderkey"]).select("o_orderkey"), 40, 13)


@query("select o_custkey, o_orderkey, rn from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) rn from orders) where rn <= 3")
def top_n_row_number(spark, d):
    return O.top_n_row_number(_t(spark, d, "orders"), ["o_custkey"], ["o_totalprice desc", "o_orderkey"], 3, "rn").select("o_custkey", "o_orderkey", "rn")


@query("select o_orderstatus, o_orderkey, rn from (select o_orderstatus, o_orderkey, dense_rank() over (partition by o_orderstatus order by o_orderdate) rn from orders) where rn <= 5")
def top_n_dense_rank(spark, d):
    return O.top_n_row_number(_t(spark, d, "orders"), ["o_orderstatus"], ["o_orderdate"], 5, "rn", "dense_rank").select("o_orderstatus", "o_orderkey", "rn")


@query("select c_nationkey, count(*) n, max(rn) top from (select c_nationkey, row_number() over (partition by c_nationkey) rn from customer) where rn <= 20 group by 1")
def row_number_limit(spark, d):
    return O.row_number(_t(spark, d, "customer"), ["c_nationkey"], "rn", 20).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.max("rn").alias("top"))


@query("""select event_id, row_number() over w rn, rank() over w rk, dense_rank() over w dr, percent_rank() over w pr, cume_dist() over w cd, ntile(4) over w nt, lag(value, 2) over w lg, lead(value, 1, -1.0) over w ld,
first_value(value) over w fv, last_value(value) over (w rows between unbounded preceding and unbounded following) lv, nth_value(value, 3) over (w rows between unbounded preceding and unbounded following) nv
from events window w as (partition by user_id order by ts, event_id)""")
def window_functions(spark, d):
    e = _t(spark, d, "events")
    fns = {"rn": F.row_number(), "rk": F.rank(), "dr": F.dense_rank(), "pr": F.percent_rank(), "cd": F.cume_dist(), "nt": F.ntile(4), "lg": F.lag("value", 2), "ld": F.lead("value", 1, -1.0), "fv": F.first_value("value")}
    x = O.window(e, ["user_id"], ["ts", "event_id"], fns)
    x = O.window(x, ["user_id"], ["ts", "event_id"], {"lv": F.last_value("value"), "nv": F.nth_value("value", 3)}, rows=(None, None))
    whole = [F.col(c).cast("bigint").alias(c) for c in ("rn", "rk", "dr", "nt")]
    return x.select("event_id", *whole, "pr", "cd", "lg", "ld", "fv", "lv", "nv")


@query("""select event_id, round(sum(value) over (partition by user_id order by event_id rows between 2 preceding and 1 following), 6) s, count(*) over (partition by event_type order by event_id range between 50 preceding and 50 following) n from events""")
def window_frames(spark, d):
    x = O.window(_t(spark, d, "events"), ["user_id"], ["event_id"], {"s": F.sum("value")}, rows=(-2, 1))
    x = O.window(x, ["event_type"], ["event_id"], {"n": F.count(F.lit(1))}, range_=(-50, 50))
    return x.select("event_id", F.round("s", 6).alias("s"), "n")


@query("""select event_id, last_value(case when value > 50 then value end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) big from events""")
def window_ignore_nulls(spark, d):
    e = _t(spark, d, "events").withColumn("b", F.when(F.col("value") > 50, F.col("value")))
    return O.window(e, ["user_id"], ["event_id"], {"big": F.last_value("b", True)}, rows=(None, -1)).select("event_id", "big")


@query("""select o_orderkey, max(o_totalprice) over (partition by o_custkey order by o_orderkey rows between (o_orderkey % 3) preceding and (o_orderkey % 2) following) top from orders""")
def window_column_frame(spark, d):
    o = _t(spark, d, "orders")
    return O.column_frame(o, ["o_custkey"], ["o_orderkey"], "o_totalprice", -(F.col("o_orderkey") % 3), F.col("o_orderkey") % 2, F.array_max, "top").select("o_orderkey", "top")


@query("""select o_orderkey, lag(o_totalprice, (o_orderkey % 3)::int) over (partition by o_custkey order by o_orderkey) prev from orders""")
def window_column_lag(spark, d):
    return O.offset_by(_t(spark, d, "orders"), ["o_custkey"], ["o_orderkey"], "o_totalprice", F.col("o_orderkey") % 3, "prev").select("o_orderkey", "prev")


@query("select o_orderkey, ntile(7) over (partition by o_orderstatus order by o_orderkey) b from orders")
def window_column_ntile(spark, d):
    return O.ntile_by(_t(spark, d, "orders"), ["o_orderstatus"], ["o_orderkey"], F.lit(7), "b").select("o_orderkey", "b")


@query("""with x as (select c_custkey, [c_nationkey, c_custkey % 3, null] a, ['x', 'y'] b from customer where c_custkey <= 50) select c_custkey, a[i]::bigint a_e, b[i] b_e, i::bigint ord from x, range(1, 4) r(i)""")
def unnest_zip(spark, d):
    x = _t(spark, d, "customer").where("c_custkey <= 50").select("c_custkey", F.expr("array(cast(c_nationkey as bigint), c_custkey % 3, null)").alias("a"), F.expr("array('x', 'y')").alias("b"))
    return O.unnest(x, ["a", "b"], ["c_custkey"], "ord")


@query("""select c_custkey, k::bigint m_k, k * 10::bigint m_v from customer, (values (1), (2)) t(k) where c_custkey <= 20""")
def unnest_map(spark, d):
    x = _t(spark, d, "customer").where("c_custkey <= 20").select("c_custkey", F.expr("map(1L, 10L, 2L, 20L)").alias("m"))
    return O.unnest(x, ["m"], ["c_custkey"])


@query("""select c_custkey, case when c_custkey % 2 = 0 then c_custkey end a_e, c_custkey % 2 = 0 as has from customer where c_custkey <= 20""")
def unnest_marker(spark, d):
    x = _t(spark, d, "customer").where("c_custkey <= 20").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.array("c_custkey")).alias("a"))
    return O.unnest(x, ["a"], ["c_custkey"], marker="has")


@query("select s_nationkey k from supplier union all select c_nationkey from customer")
def union_all(spark, d):
    return O.union_all(_t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), _t(spark, d, "customer").select(F.col("c_nationkey").alias("k")))


def _set(name: str, sql_op: str):
    def f(spark, d):
        return getattr(O, name)(_t(spark, d, "lineitem").where("l_quantity < 20").select(F.col("l_suppkey").alias("k")), _t(spark, d, "lineitem").where("l_quantity > 45 and l_suppkey % 3 > 0").select(F.col("l_suppkey").alias("k")))

    f.__name__ = f"set_{name}"
    query(f"select l_suppkey k from lineitem where l_quantity < 20 {sql_op} select l_suppkey from lineitem where l_quantity > 45 and l_suppkey % 3 > 0")(f)


for _n, _s in (("union_distinct", "union"), ("intersect_distinct", "intersect"), ("except_distinct", "except"), ("intersect_all", "intersect all"), ("except_all", "except all")):
    _set(_n, _s)


@query("select l_returnflag, count(*) n, avg(l_quantity)::double a, round(var_samp(l_quantity), 4) v, round(stddev_pop(l_quantity), 6) s from lineitem group by 1")
def partial_merge_extract(spark, d):
    """Aggregates by states per (flag, supplier), merged per flag."""
    q, P = F.col("l_quantity"), O.partial_state
    states = _t(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(P.partial("count", q).alias("c"), P.partial("avg", q).alias("a"), P.partial("var_samp", q).alias("v"))
    merged = states.groupBy("l_returnflag").agg(P.merge("count", F.col("c")).alias("c"), P.merge("avg", F.col("a")).alias("a"), P.merge("var_samp", F.col("v")).alias("v"))
    return merged.select("l_returnflag", P.extract("count", F.col("c")).alias("n"), P.extract("avg", F.col("a")).alias("a"), F.round(P.extract("var_samp", F.col("v")), 4).alias("v"), F.round(P.extract("stddev_pop", F.col("v")), 6).alias("s"))


@query("""select l_returnflag, count(*) filter (l_tax > 0.04) ci, round(covar_pop(l_quantity, l_tax), 6) cp, round(corr(l_extendedprice, l_quantity), 6) co, round(regr_slope(l_extendedprice, l_quantity), 4) sl, round(regr_intercept(l_extendedprice, l_quantity), 2) ic, round(regr_r2(l_extendedprice, l_quantity), 6) r2,
count(*) rc, bool_and(l_quantity > 0) ba, bit_or(l_linenumber) bo, max(l_quantity) mx, arg_max(l_orderkey, l_extendedprice) mb, round(exp(avg(ln(l_quantity))), 6) gm, list_sort(list(distinct l_linenumber)) sa, len(list(l_linenumber))::bigint aa,
round(sum(pow(l_quantity - m, 3)) / count(*) / pow(sum(pow(l_quantity - m, 2)) / count(*), 1.5), 5) sk, round(sum(pow(l_quantity - m, 4)) / count(*) / pow(sum(pow(l_quantity - m, 2)) / count(*), 2) - 3, 5) ku
from (select *, avg(l_quantity) over (partition by l_returnflag) m from lineitem) group by 1""")
def partial_states(spark, d):
    """Many kinds of states per (flag, supplier), merged per flag."""
    P = O.partial_state
    pair = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    price = pair("l_extendedprice", "l_quantity")
    # of rows of one price the first order
    top = F.struct(F.col("l_orderkey").alias("x"), F.when(F.col("l_extendedprice").isNotNull(), F.struct(F.col("l_extendedprice"), -F.col("l_orderkey"))).alias("y"))
    kinds = {
        "ci": ("count_if", F.col("l_tax") > 0.04), "cp": ("covar_pop", pair("l_quantity", "l_tax")), "co": ("corr", price), "sl": ("regr_slope", price), "ic": ("regr_intercept", price), "r2": ("regr_r2", price), "rc": ("regr_count", price), "ba": ("bool_and", F.col("l_quantity") > 0),
        "bo": ("bitwise_or_agg", F.col("l_linenumber")), "mx": ("max", F.col("l_quantity")), "mb": ("max_by", top), "gm": ("geometric_mean", F.col("l_quantity")), "sa": ("set_agg", F.col("l_linenumber")), "aa": ("array_agg", F.col("l_linenumber")),
        "sk": ("skewness", F.col("l_quantity")), "ku": ("kurtosis", F.col("l_quantity")),
    }
    states = _t(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(*[P.partial(k, x).alias(n) for n, (k, x) in kinds.items()])
    merged = states.groupBy("l_returnflag").agg(*[P.merge(k, F.col(n)).alias(n) for n, (k, _) in kinds.items()])
    value = {n: P.extract(k, F.col(n)) for n, (k, _) in kinds.items()}
    digits = {"cp": 6, "co": 6, "sl": 4, "ic": 2, "r2": 6, "gm": 6, "sk": 5, "ku": 5}
    value |= {n: F.round(value[n], k) for n, k in digits.items()} | {"sa": F.array_sort(value["sa"]), "aa": F.size(value["aa"]).cast("bigint")}
    return merged.select("l_returnflag", *[c.alias(n) for n, c in value.items()])


@query("select o_orderkey from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0 and o_orderkey % 2 = 1")
def sorted_merge(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey")
    return O.sorted_merge([o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0 and o_orderkey % 2 = 1")], ["o_orderkey"])


@query("select o_custkey, count(*) n from orders group by 1")
def exchange_partitioned(spark, d):
    return O.partitioned_output(_t(spark, d, "orders"), "hash", ["o_custkey"]).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("""select c_custkey, n_nationkey from customer join nation on c_custkey % 100 between n_nationkey and n_nationkey + 5 and c_custkey % 90 between n_nationkey and n_nationkey + 5""")
def join_spatial(spark, d):
    """Points in boxes."""
    from lodespar.functions import call

    points = _t(spark, d, "customer").select("c_custkey", call("ansi", "ST_Point", (F.col("c_custkey") % 100).cast("double"), (F.col("c_custkey") % 90).cast("double")).alias("p"))
    box = F.format_string("POLYGON ((%d %d, %d %d, %d %d, %d %d, %d %d))", *[x for a, b in ((0, 0), (5, 0), (5, 5), (0, 5), (0, 0)) for x in (F.col("n_nationkey") + a, F.col("n_nationkey") + b)])
    boxes = _t(spark, d, "nation").select("n_nationkey", call("ansi", "ST_GeometryFromText", box).alias("b"))
    return O.spatial_join(boxes, points, "b", "p", "ST_Intersects", 5.0).select("c_custkey", "n_nationkey")


@query("""select l_returnflag, list(l_orderkey order by l_extendedprice, l_orderkey)[1:5] first5, count(*) n from lineitem group by 1""")
def aggregate_sorted_inputs(spark, d):
    from lodespar.functions import call

    ordered = call("ansi", "array_agg_ordered", "l_orderkey", "l_extendedprice", "l_orderkey")
    return _t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.slice(ordered, 1, 5).alias("first5"), F.count(F.lit(1)).alias("n"))


@query("select c_custkey, c_name, n_name from customer join nation on c_nationkey = n_nationkey")
def join_broadcast_hint(spark, d):
    return O.hash_join(_t(spark, d, "customer"), _t(spark, d, "nation"), ["c_nationkey"], ["n_nationkey"], hint="broadcast").select("c_custkey", "c_name", "n_name")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"rel_{k}": f for k, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {f"rel_{k}": s for k, s in SQL.items()}
