import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from lodespar.functions import register
from lodespar.plans.builder import Plan


def test_plan(spark, sf_dir, same):
    p = Plan(spark)
    orders = p.table_scan(f"{sf_dir}/orders.parquet", columns=["o_orderkey", "o_custkey", "o_totalprice"], filters=["o_totalprice > 1000"])
    cust = p.table_scan(f"{sf_dir}/customer.parquet", columns=["c_custkey", "c_nationkey"])
    got = orders.hash_join(["o_custkey"], ["c_custkey"], cust, ["c_nationkey", "o_orderkey"]).aggregate(["c_nationkey"], ["count(*) as n"]).order_by(["n desc", "c_nationkey"]).limit(5)
    same(got.frame(), "select c_nationkey, count(*) n from orders join customer on o_custkey = c_custkey where o_totalprice > 1000 group by 1 order by 2 desc, 1 limit 5")
    same(p.sql("select count(*) n from v", v=cust).frame(), "select count(*) n from customer")
    assert len(list(p.values([(1,), (2,)], "x int", repeat=3).rows())) == 6


def test_user_functions(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, None, "b"), (3, 4.0, "a")], "i int, x double, s string")
    twice = register.scalar("twice", lambda v: 2 * v, "double", spark)
    assert [r[0] for r in df.select(twice("x")).collect()] == [4.0, None, 8.0]
    assert spark.sql("select twice(1.5D)").first()[0] == 3.0
    register.vector("size_of", lambda a: pc.utf8_length(a), "int")
    register.overload("size_of", ("double",), lambda c: F.lit(8))
    assert df.select(register.resolve("size_of", df, "s").alias("a"), register.resolve("size_of", df, "x").alias("b")).first() == (1, 8)
    got = register.aggregate(df, ["s"], ["i"], lambda t: {"n": t.num_rows, "total": pc.sum(t["i"]).as_py()}, lambda ss: {"mean": sum(s["total"] for s in ss) / sum(s["n"] for s in ss)}, "n bigint, total bigint", "mean double")
    assert {tuple(r) for r in got.collect()} == {("a", 2.0), ("b", 2.0)}
    assert register.table(df, lambda bs: (pa.record_batch([pa.array([b.num_rows])], names=["n"]) for b in bs), "n bigint").agg(F.sum("n")).first()[0] == 3
