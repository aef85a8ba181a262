"""Decision-support queries over the star schema, by the DataFrame API.

The tables lack some columns of the usual schema (ship modes, commit and
receipt dates, comments, part suppliers); queries that need them take the
nearest columns at hand, and keep their shape: joins, subqueries, grouping.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _revenue():
    """In decimals, so that sums don't depend on the order of rows."""
    return (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")


def q1(spark, sf_dir):
    """Pricing summary."""
    price = _revenue()
    return (
        _t(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate") <= _ts("1998-09-02"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
            F.round(F.sum(price).cast("double"), 2).alias("sum_disc_price"),
            F.round(F.sum((price * (1 + F.col("l_tax"))).cast("decimal(18,4)")).cast("double"), 2).alias("sum_charge"),
            F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
            F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
            F.round(F.avg("l_discount"), 4).alias("avg_disc"),
            F.count(F.lit(1)).alias("count_order"),
        )
    )


def q2(spark, sf_dir):
    """The supplier with the largest balance for each nation's parts of one size, by quantity sold."""
    part = _t(spark, sf_dir, "part").where("p_size = 15").select("p_partkey", "p_brand")
    line = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    supp = _t(spark, sf_dir, "supplier").join(F.broadcast(_t(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    x = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    best = x.groupBy("p_partkey").agg(F.max("s_acctbal").alias("best"))
    return x.join(best, "p_partkey").where("s_acctbal = best").select("p_partkey", "p_brand", "s_suppkey", "s_acctbal", "n_name")


def q3(spark, sf_dir):
    """Shipping priority."""
    c = _t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = _t(spark, sf_dir, "orders").where(F.col("o_orderdate") < _ts("1998-03-15"))
    li = _t(spark, sf_dir, "lineitem").where(F.col("l_shipdate") > _ts("1998-03-15"))
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    return x.groupBy("l_orderkey", "o_orderdate", "o_orderpriority").agg(F.round(F.sum(_revenue()).cast("double"), 2).alias("revenue")).orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey").limit(10)


def q4(spark, sf_dir):
    """Orders of a quarter with a late line, by priority."""
    o = _t(spark, sf_dir, "orders").where((F.col("o_orderdate") >= _ts("1997-07-01")) & (F.col("o_orderdate") < _ts("1997-10-01")))
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    on = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate") + F.expr("interval 60 days"))
    return o.join(li, on, "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("order_count"))


def q5(spark, sf_dir):
    """Revenue of local suppliers by nation."""
    r = _t(spark, sf_dir, "region").where("r_name = 'ASIA'")
    n = _t(spark, sf_dir, "nation").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    s = _t(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    o = _t(spark, sf_dir, "orders").where((F.col("o_orderdate") >= _ts("1996-01-01")) & (F.col("o_orderdate") < _ts("1998-01-01")))
    x = _t(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.join(_t(spark, sf_dir, "customer"), (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return x.groupBy("n_name").agg(F.round(F.sum(_revenue()).cast("double"), 2).alias("revenue"))


def q6(spark, sf_dir):
    """Forecast of revenue change."""
    return (
        _t(spark, sf_dir, "lineitem")
        .where((F.col("l_shipdate") >= _ts("1997-01-01")) & (F.col("l_shipdate") < _ts("1998-01-01")) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
        .agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))
    )


def q7(spark, sf_dir):
    """Volume shipped between nations by year; both sides are cut to the two regions before the large joins."""
    n = _t(spark, sf_dir, "nation").where("n_regionkey in (1, 2)")
    s = _t(spark, sf_dir, "supplier").join(F.broadcast(n.select(F.col("n_nationkey").alias("k1"), F.col("n_name").alias("supp_nation"), F.col("n_regionkey").alias("r1"))), F.col("s_nationkey") == F.col("k1")).select("s_suppkey", "supp_nation", "r1")
    c = _t(spark, sf_dir, "customer").join(F.broadcast(n.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("cust_nation"), F.col("n_regionkey").alias("r2"))), F.col("c_nationkey") == F.col("k2")).select("c_custkey", "cust_nation", "r2")
    o = _t(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "cust_nation", "r2")
    x = _t(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).where("r1 <> r2")
    return x.groupBy("supp_nation", "cust_nation", F.year("l_shipdate").cast("bigint").alias("l_year")).agg(F.round(F.sum(_revenue()).cast("double"), 2).alias("revenue"))


def q8(spark, sf_dir):
    """Market share of one nation in its region by year."""
    n = _t(spark, sf_dir, "nation")
    cust = _t(spark, sf_dir, "customer").join(F.broadcast(n.where("n_regionkey = 1").select("n_nationkey")), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    part = _t(spark, sf_dir, "part").where("p_type = 'ECONOMY'")
    supp = _t(spark, sf_dir, "supplier").join(F.broadcast(n.select(F.col("n_nationkey").alias("k"), "n_name")), F.col("s_nationkey") == F.col("k"))
    x = _t(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.join(cust, F.col("o_custkey") == F.col("c_custkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    share = F.sum(F.when(F.col("s_nationkey") == 2, _revenue())).cast("double") / F.sum(_revenue()).cast("double")
    return x.groupBy(F.year("o_orderdate").cast("bigint").alias("o_year")).agg(F.round(share, 6).alias("mkt_share"))


def q9(spark, sf_dir):
    """Profit by nation and year for one kind of part."""
    part = _t(spark, sf_dir, "part").where("p_brand like '%1%'").select("p_partkey", "p_retailprice")
    supp = _t(spark, sf_dir, "supplier").join(F.broadcast(_t(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    x = _t(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey")).join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    amount = _revenue() - F.col("p_retailprice") * 0.5 * F.col("l_quantity")
    return x.groupBy("n_name", F.year("o_orderdate").cast("bigint").alias("o_year")).agg(F.round(F.sum(amount.cast("decimal(18,4)")).cast("double"), 2).alias("sum_profit"))


def q10(spark, sf_dir):
    """Customers with the largest returns."""
    o = _t(spark, sf_dir, "orders").where((F.col("o_orderdate") >= _ts("1997-10-01")) & (F.col("o_orderdate") < _ts("1998-01-01")))
    li = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(_t(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.groupBy("c_custkey", "c_name", "c_acctbal", "n_name").agg(F.round(F.sum(_revenue()).cast("double"), 2).alias("revenue")).orderBy(F.desc("revenue"), "c_custkey").limit(20)


def q11(spark, sf_dir):
    """Parts whose value is a notable share of one nation's total; the total is that of the groups, so lines are read once."""
    s = _t(spark, sf_dir, "supplier").where("s_nationkey = 7")
    x = _t(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    by = x.groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("v"))
    total = by.agg((F.sum("v") * 0.001).alias("least"))
    return by.join(F.broadcast(total), F.col("v") > F.col("least")).select("l_partkey", F.round("v", 2).alias("value"))


def q12(spark, sf_dir):
    """Lines by return flag and urgency of their order."""
    li = _t(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= _ts("1997-01-01")) & (F.col("l_shipdate") < _ts("1998-01-01")) & F.col("l_returnflag").isin("A", "R"))
    high = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return li.join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_returnflag").agg(F.count_if(high).alias("high_line_count"), F.count_if(~high).alias("low_line_count"))


def q13(spark, sf_dir):
    """Distribution of customers by number of orders."""
    o = _t(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'").select("o_custkey", "o_orderkey")
    per = _t(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("c_count"))
    return per.groupBy("c_count").agg(F.count(F.lit(1)).alias("custdist"))


def q14(spark, sf_dir):
    """Share of revenue from promotions."""
    li = _t(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= _ts("1997-09-01")) & (F.col("l_shipdate") < _ts("1997-10-01")))
    promo = F.sum(F.when(F.col("p_type").startswith("PROMO"), _revenue())).cast("double")
    return li.join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).agg(F.round(100 * promo / F.sum(_revenue()).cast("double"), 4).alias("promo_revenue"))


def q15(spark, sf_dir):
    """The supplier with the most revenue in a quarter."""
    rev = _t(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= _ts("1997-01-01")) & (F.col("l_shipdate") < _ts("1997-04-01"))).groupBy("l_suppkey").agg(F.round(F.sum(_revenue()).cast("double"), 2).alias("total_revenue"))
    top = rev.agg(F.max("total_revenue").alias("most"))
    return rev.join(F.broadcast(top), F.col("total_revenue") == F.col("most")).join(_t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_suppkey", "s_name", "total_revenue")


def q16(spark, sf_dir):
    """Suppliers of kinds of parts, without those in debt."""
    part = _t(spark, sf_dir, "part").where("p_brand <> 'Brand#45' and p_type not like 'MEDIUM%' and p_size in (49, 14, 23, 45, 19, 3, 36, 9)")
    poor = _t(spark, sf_dir, "supplier").where("s_acctbal < 0").select("s_suppkey")
    x = _t(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).join(poor, F.col("l_suppkey") == F.col("s_suppkey"), "left_anti")
    return x.groupBy("p_brand", "p_type", "p_size").agg(F.count_distinct("l_suppkey").alias("supplier_cnt"))


def q17(spark, sf_dir):
    """Revenue lost without small orders of a part."""
    part = _t(spark, sf_dir, "part").where("p_brand = 'Brand#23'").select("p_partkey")
    li = _t(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_partkey", "l_quantity", "l_extendedprice")
    small = li.groupBy("l_partkey").agg((0.2 * F.avg("l_quantity")).alias("least"))
    return li.join(small, "l_partkey").where("l_quantity < least").agg(F.round(F.sum("l_extendedprice") / 7.0, 2).alias("avg_yearly"))


def q18(spark, sf_dir):
    """Large orders."""
    big = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("sum_qty")).where("sum_qty > 200")
    x = big.join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return x.select("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", F.round("sum_qty", 2).alias("sum_qty")).orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey").limit(100)


def q19(spark, sf_dir):
    """Discounted revenue under alternatives of brand, size and quantity."""
    x = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    cond = "(p_brand = 'Brand#12' and l_quantity between 1 and 21 and p_size between 1 and 25) or (p_brand = 'Brand#23' and l_quantity between 10 and 30 and p_size between 1 and 35) or (p_brand = 'Brand#34' and l_quantity between 20 and 40 and p_size between 1 and 45)"
    return x.where(cond).agg(F.round(F.sum(_revenue()).cast("double"), 2).alias("revenue"))


def q20(spark, sf_dir):
    """Suppliers who sold much of some part in a year."""
    li = _t(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= _ts("1997-01-01")) & (F.col("l_shipdate") < _ts("1998-01-01")))
    part = _t(spark, sf_dir, "part").where("p_brand like 'Brand#1%'")
    many = li.join(part, F.col("l_partkey") == F.col("p_partkey"), "left_semi").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q")).where("q > 45")
    return _t(spark, sf_dir, "supplier").join(many, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", "s_name")


def q21(spark, sf_dir):
    """Suppliers who alone held up orders of many suppliers: an order has several if its least and largest supplier differ, and one late one if these agree."""
    li = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"))
    late = F.when(F.col("l_shipdate") > F.col("o_orderdate") + F.expr("interval 90 days"), F.col("l_suppkey"))
    per = li.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b"), F.min(late).alias("l_suppkey"), F.max(late).alias("last"))
    return per.where("a < b and l_suppkey = last").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("numwait"))


def q22(spark, sf_dir):
    """Customers with means but no orders, by nation."""
    c = _t(spark, sf_dir, "customer").where("c_nationkey in (3, 7, 11, 13, 17, 19, 23)")
    mean = c.where("c_acctbal > 0").agg(F.avg("c_acctbal").alias("mean"))
    rich = c.join(F.broadcast(mean), F.col("c_acctbal") > F.col("mean"))
    late = _t(spark, sf_dir, "orders").where(F.col("o_orderdate") >= _ts("1999-01-01"))
    rest = rich.join(late, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return rest.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("numcust"), F.round(F.sum("c_acctbal"), 2).alias("totacctbal"))


_R = "cast(l_extendedprice * (1 - l_discount) as decimal(18,4))"
SQL = {
    "q1": f"""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) sum_qty, round(sum(l_extendedprice), 2) sum_base_price,
round(sum({_R})::double, 2) sum_disc_price, round(sum(cast({_R} * (1 + l_tax) as decimal(18,4)))::double, 2) sum_charge,
round(avg(l_quantity), 4) avg_qty, round(avg(l_extendedprice), 4) avg_price, round(avg(l_discount), 4) avg_disc, count(*) count_order
from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""",
    "q2": """with x as (select distinct p_partkey, p_brand, s_suppkey, s_acctbal, n_name from lineitem join part on l_partkey = p_partkey and p_size = 15 join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey)
select * from x where s_acctbal = (select max(s_acctbal) from x y where y.p_partkey = x.p_partkey)""",
    "q3": f"""select l_orderkey, o_orderdate, o_orderpriority, round(sum({_R})::double, 2) revenue from customer, orders, lineitem where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey
and o_orderdate < timestamp '1998-03-15' and l_shipdate > timestamp '1998-03-15' group by all order by revenue desc, o_orderdate, l_orderkey limit 10""",
    "q4": """select o_orderpriority, count(*) order_count from orders where o_orderdate >= timestamp '1997-07-01' and o_orderdate < timestamp '1997-10-01'
and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_shipdate > o_orderdate + interval 60 day) group by all""",
    "q5": f"""select n_name, round(sum({_R})::double, 2) revenue from customer, orders, lineitem, supplier, nation, region where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey
and c_nationkey = s_nationkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'ASIA' and o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1998-01-01' group by all""",
    "q6": "select round(sum(l_extendedprice * l_discount), 2) revenue from lineitem where l_shipdate >= timestamp '1997-01-01' and l_shipdate < timestamp '1998-01-01' and l_discount between 0.05 and 0.07 and l_quantity < 24",
    "q7": f"""select n1.n_name supp_nation, n2.n_name cust_nation, year(l_shipdate)::bigint l_year, round(sum({_R})::double, 2) revenue from supplier, lineitem, orders, customer, nation n1, nation n2
where s_suppkey = l_suppkey and o_orderkey = l_orderkey and c_custkey = o_custkey and s_nationkey = n1.n_nationkey and c_nationkey = n2.n_nationkey and (n1.n_regionkey = 1 and n2.n_regionkey = 2 or n1.n_regionkey = 2 and n2.n_regionkey = 1) group by all""",
    "q8": f"""select year(o_orderdate)::bigint o_year, round(sum(case when s_nationkey = 2 then {_R} end)::double / sum({_R})::double, 6) mkt_share from part, supplier, lineitem, orders, customer, nation
where p_partkey = l_partkey and s_suppkey = l_suppkey and l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n_nationkey and n_regionkey = 1 and p_type = 'ECONOMY' group by all""",
    "q9": f"""select n_name, year(o_orderdate)::bigint o_year, round(sum(cast({_R} - p_retailprice * 0.5 * l_quantity as decimal(18,4)))::double, 2) sum_profit from part, supplier, lineitem, orders, nation
where p_partkey = l_partkey and s_suppkey = l_suppkey and o_orderkey = l_orderkey and s_nationkey = n_nationkey and p_brand like '%1%' group by all""",
    "q10": f"""select c_custkey, c_name, c_acctbal, n_name, round(sum({_R})::double, 2) revenue from customer, orders, lineitem, nation where c_custkey = o_custkey and l_orderkey = o_orderkey
and o_orderdate >= timestamp '1997-10-01' and o_orderdate < timestamp '1998-01-01' and l_returnflag = 'R' and c_nationkey = n_nationkey group by all order by revenue desc, c_custkey limit 20""",
    "q11": """with x as (select * from lineitem where l_suppkey in (select s_suppkey from supplier where s_nationkey = 7)) select l_partkey, round(sum(l_extendedprice), 2) as value from x group by l_partkey having sum(l_extendedprice) > (select sum(l_extendedprice) * 0.001 from x)""",
    "q12": """select l_returnflag, count(*) filter (o_orderpriority in ('1-URGENT', '2-HIGH')) high_line_count, count(*) filter (o_orderpriority not in ('1-URGENT', '2-HIGH')) low_line_count
from lineitem, orders where l_orderkey = o_orderkey and l_shipdate >= timestamp '1997-01-01' and l_shipdate < timestamp '1998-01-01' and l_returnflag in ('A', 'R') group by all""",
    "q13": "select c_count, count(*) custdist from (select c_custkey, count(o_orderkey) c_count from customer left join orders on c_custkey = o_custkey and o_orderpriority <> '5-LOW' group by 1) group by 1",
    "q14": f"select round(100 * sum(case when p_type like 'PROMO%' then {_R} end)::double / sum({_R})::double, 4) promo_revenue from lineitem, part where l_partkey = p_partkey and l_shipdate >= timestamp '1997-09-01' and l_shipdate < timestamp '1997-10-01'",
    "q15": f"""with r as (select l_suppkey, round(sum({_R})::double, 2) total_revenue from lineitem where l_shipdate >= timestamp '1997-01-01' and l_shipdate < timestamp '1997-04-01' group by 1)
select s_suppkey, s_name, total_revenue from supplier, r where s_suppkey = l_suppkey and total_revenue = (select max(total_revenue) from r)""",
    "q16": """select p_brand, p_type, p_size, count(distinct l_suppkey) supplier_cnt from lineitem, part where p_partkey = l_partkey and p_brand <> 'Brand#45' and p_type not like 'MEDIUM%' and p_size in (49, 14, 23, 45, 19, 3, 36, 9)
and l_suppkey not in (select s_suppkey from supplier where s_acctbal < 0) group by all""",
    "q17": "select round(sum(l_extendedprice) / 7.0, 2) avg_yearly from lineitem l, part where p_partkey = l_partkey and p_brand = 'Brand#23' and l_quantity < (select 0.2 * avg(l_quantity) from lineitem where l_partkey = p_partkey)",
    "q18": """select c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) sum_qty from customer, orders, lineitem where o_orderkey in (select l_orderkey from lineitem group by 1 having sum(l_quantity) > 200)
and c_custkey = o_custkey and o_orderkey = l_orderkey group by all order by o_totalprice desc, o_orderdate, o_orderkey limit 100""",
    "q19": f"""select round(sum({_R})::double, 2) revenue from lineitem, part where p_partkey = l_partkey and ((p_brand = 'Brand#12' and l_quantity between 1 and 21 and p_size between 1 and 25) or (p_brand = 'Brand#23' and l_quantity between 10 and 30 and p_size between 1 and 35)
or (p_brand = 'Brand#34' and l_quantity between 20 and 40 and p_size between 1 and 45))""",
    "q20": """select s_suppkey, s_name from supplier where s_suppkey in (select l_suppkey from lineitem where l_partkey in (select p_partkey from part where p_brand like 'Brand#1%') and l_shipdate >= timestamp '1997-01-01' and l_shipdate < timestamp '1998-01-01'
group by l_partkey, l_suppkey having sum(l_quantity) > 45)""",
    "q21": """with x as (select l_orderkey, l_suppkey, l_shipdate > o_orderdate + interval 90 day late from lineitem join orders on l_orderkey = o_orderkey and o_orderstatus = 'F'),
p as (select l_orderkey from x group by 1 having count(distinct l_suppkey) > 1 and count(distinct l_suppkey) filter (late) = 1)
select l_suppkey, count(*) numwait from (select distinct l_orderkey, l_suppkey from x where late and l_orderkey in (select l_orderkey from p)) group by 1""",
    "q22": """with c as (select * from customer where c_nationkey in (3, 7, 11, 13, 17, 19, 23)) select c_nationkey, count(*) numcust, round(sum(c_acctbal), 2) totacctbal from c
where c_acctbal > (select avg(c_acctbal) from c where c_acctbal > 0) and not exists (select 1 from orders where o_custkey = c_custkey and o_orderdate >= timestamp '1999-01-01') group by 1""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"q{i}": globals()[f"q{i}"] for i in range(1, 23)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
