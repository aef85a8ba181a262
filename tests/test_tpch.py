from pyspark.sql import functions as F

from lodespar.plans.builder import Plan
from lodespar.sources import tpch_table


def test_tables(spark):
    t = {n: tpch_table(spark, n, 0.001, seed=3, partitions=2) for n in ("region", "nation", "supplier", "customer", "part", "partsupp", "orders", "lineitem")}
    counts = {n: df.count() for n, df in t.items()}
    assert counts == {"region": 5, "nation": 25, "supplier": 10, "customer": 150, "part": 200, "partsupp": 800, "orders": 1500, "lineitem": counts["lineitem"]} and 4500 < counts["lineitem"] < 7500
    li, o = t["lineitem"], t["orders"]
    assert li.join(t["partsupp"], (F.col("l_partkey") == F.col("ps_partkey")) & (F.col("l_suppkey") == F.col("ps_suppkey")), "left_anti").count() == 0
    assert li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").count() == 0 and o.join(t["customer"], F.col("o_custkey") == F.col("c_custkey"), "left_anti").count() == 0
    assert o.agg(F.count_distinct("o_orderkey")).first()[0] == 1500 and o.agg(F.count_distinct("o_custkey")).first()[0] <= 100
    total = li.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 + F.col("l_tax")) * (1 - F.col("l_discount"))).alias("s"))
    assert o.join(total, F.col("o_orderkey") == F.col("l_orderkey")).where(F.abs(F.col("s") - F.col("o_totalprice")) > 0.01).count() == 0
    assert li.where("l_receiptdate <= l_shipdate or l_quantity not between 1 and 50 or (l_linestatus = 'O') <> (l_shipdate > date '1995-06-17')").count() == 0
    again = tpch_table(spark, "lineitem", 0.001, seed=3, partitions=5)
    assert again.exceptAll(li).count() == 0 == li.exceptAll(again).count()
    assert Plan(spark).tpch_gen("nation", ["n_name", "n_regionkey"]).filter("n_regionkey = 3").frame().count() == 5
