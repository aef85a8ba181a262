"""Queries that write and read tables, run streams to their end, and call functions of the user."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespar import sources, streaming
from lodespar.functions import call, register

from .builder import Plan
from .tpch import _t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _scratch(spark: SparkSession) -> str:
    """A new folder that all executors share; a local one only where all runs in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(named or 'file://' + tempfile.gettempdir()).rstrip('/')}/lodespar-{uuid.uuid4().hex}"


@query("select o_orderkey, o_orderstatus, o_totalprice from orders where o_totalprice > 250000")
def src_partitions(spark, d):
    path = _scratch(spark)
    sources.write_table(_t(spark, d, "orders"), path, partition_by=["o_orderstatus"], sort_by=["o_totalprice"])
    return sources.read_files(spark, path, columns=["o_orderkey", "o_orderstatus", "o_totalprice"], filters=["o_totalprice > 250000"])


@query("select count(*) n, 0::bigint nulls, min(o_totalprice) least, max(o_totalprice) most from orders")
def src_statistics(spark, d):
    found = sources.write_table(_t(spark, d, "orders"), _scratch(spark), most_rows=1000, stats=["o_totalprice"])
    return spark.createDataFrame([(found["rows"], found["o_totalprice_nulls"], found["o_totalprice_min"], found["o_totalprice_max"])], "n bigint, nulls bigint, least double, most double")


def _format(kind: str):
    def f(spark, d):
        path = _scratch(spark)
        sources.write_table(_t(spark, d, "customer"), path, kind)
        return sources.read_files(spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", kind=kind, filters=["c_acctbal > 0"])

    f.__name__ = f"src_{kind}"
    query("select * from customer where c_acctbal > 0")(f)


for _k in ("orc", "csv", "json"):
    _format(_k)


@query("select c_custkey, c_custkey as place, true as named, true as sized from customer")
def src_hidden_columns(spark, d):
    df = sources.info_columns(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.col("_metadata.row_index").alias("place"), "_metadata"))
    return df.select("c_custkey", "place", F.col("`$path`").contains("customer").alias("named"), (F.col("`$file_size`") > 0).alias("sized"))


@query("select o_orderkey, o_custkey, null::double missing from orders where o_orderkey % 10 <> 0 and o_custkey not in (7, 9, 11)")
def src_deletes(spark, d):
    path = _scratch(spark)
    _t(spark, d, "orders").select("o_orderkey", "o_custkey").repartition(3).write.parquet(path)
    where = spark.read.parquet(path).where("o_orderkey % 10 = 0").select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("pos"))
    kept = sources.read_with_deletes(spark, path, where, [spark.createDataFrame([(7,), (9,), (11,)], "o_custkey bigint")])
    return kept.withColumn("missing", F.lit(None).cast("double"))


@query("select c_custkey, c_name, [c_nationkey, null, 3] a, c_custkey % 2 = 0 even, map {'k': c_acctbal}['k'] m from customer")
def src_delimited(spark, d):
    path = _scratch(spark)
    c = _t(spark, d, "customer").select("c_custkey", "c_name", F.array("c_nationkey", F.lit(None).cast("int"), F.lit(3)).alias("a"), F.struct((F.col("c_custkey") % 2 == 0).alias("even")).alias("s"), F.create_map(F.lit("k"), "c_acctbal").alias("m"))
    sources.write_delimited(c, path)
    back = sources.read_delimited(spark, path, "c_custkey bigint, c_name string, a array<int>, s struct<even:boolean>, m map<string,double>")
    return back.select("c_custkey", "c_name", "a", "s.even", F.element_at("m", "k").alias("m"))


@query("select 1000::bigint n, true some_nulls, true spread from region where r_regionkey = 0")
def src_random_rows(spark, d):
    x = sources.random_rows(spark, "a int, b string, c array<double>, t timestamp", 1000, seed=3)
    return x.agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("a").isNull()).between(50, 200)).alias("some_nulls"), (F.count_distinct("a") > 500).alias("spread"))


@query("select l_returnflag, count(*) n, round(sum(l_quantity), 2) q from lineitem where l_tax > 0.02 group by 1 order by 1 limit 2")
def plan_builder(spark, d):
    p = Plan(spark).table_scan(f"{d}/lineitem.parquet", columns=["l_returnflag", "l_quantity", "l_tax"], filters=["l_tax > 0.02"])
    return p.aggregate(["l_returnflag"], ["count(*) as n", "round(sum(l_quantity), 2) as q"]).order_by(["l_returnflag"]).limit(2).frame()


@query("select c_custkey k, c_name || '!' s, c_acctbal * 2 v, c_custkey + 1 o, upper(c_mktsegment) r from customer")
def user_scalars(spark, d):
    c = _t(spark, d, "customer")
    loud = register.scalar("loud", lambda x: x + "!", "string")
    twice = register.vector("twice", lambda x: pc.multiply(x, pa.scalar(2.0)), "double")
    register.overload("next", ("bigint",), lambda x: x + 1)
    register.overload("next", ("string",), lambda x: F.concat(x, F.lit("1")))
    register.rewrite(lambda name, args: F.upper(args[0]) if name == "shout" else None)
    return c.select(F.col("c_custkey").alias("k"), loud(F.col("c_name")).alias("s"), twice(F.col("c_acctbal")).alias("v"), register.resolve("next", c, "c_custkey").alias("o"), register.rewritten("shout", F.col("c_mktsegment")).alias("r"))


@query("select l_returnflag, sum(l_linenumber)::bigint total, count(*) n from lineitem group by 1")
def user_aggregate(spark, d):
    part = lambda t: {"s": pc.sum(t.column("l_linenumber")).as_py(), "c": t.num_rows}
    whole = lambda states: {"total": sum(x["s"] for x in states), "n": sum(x["c"] for x in states)}
    return register.aggregate(_t(spark, d, "lineitem"), ["l_returnflag"], ["l_linenumber"], part, whole, "s bigint, c bigint", "total bigint, n bigint")


@query("select r_regionkey, r_name, r_regionkey * 10 ten from region")
def user_table(spark, d):
    def f(batches):
        for b in batches:
            yield b.append_column("ten", pc.multiply(b.column("r_regionkey"), pa.scalar(10, b.column("r_regionkey").type)))

    r = _t(spark, d, "region")
    return register.table(r, f, ", ".join(f"{k} {t}" for k, t in r.dtypes) + f", ten {dict(r.dtypes)['r_regionkey']}")


@query("select i::bigint i, (i * i)::bigint sq from range(1, 6) t(i)")
def user_table_function(spark, d):
    def squares(n):
        for i in range(1, n + 1):
            yield i, i * i

    return register.table_function(spark, "squares", squares, "i bigint, sq bigint")(5)


@query("select event_id, user_id, value, round(sum(value) over (partition by user_id order by event_id), 6) running from events")
def user_window(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", "value")
    return register.window_function(e, ["user_id"], ["event_id"], lambda t: pc.cumulative_sum(t.column("value")), "running", "double").withColumn("running", F.round("running", 6))


def _events(spark, d) -> DataFrame:
    """Events as a stream of three files."""
    path = _scratch(spark)
    _t(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value").repartition(3).write.parquet(path)
    return streaming.read_stream(spark, path, spark.read.parquet(path).schema, most_files=1)


def _last(df: DataFrame, mode: str) -> DataFrame:
    """What a stream gives after all its input: all rows of append mode, the last table of complete mode."""
    spark, path = df.sparkSession, _scratch(df.sparkSession)

    def keep(batch, i):
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    writer = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", _scratch(spark)).trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.parquet(path)


@query("select date_trunc('day', ts) as day, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def stream_windows(spark, d):
    w = streaming.windowed(_events(spark, d), "ts", "1 day", ["count(*) as n", "round(sum(value), 4) as total"], ["event_type"])
    return _last(w, "complete").select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@query("""with x as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end new from events),
y as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) s from x) select user_id, min(ts) first, max(ts) + interval 6 hour last, count(*) n from y group by user_id, s""")
def stream_sessions(spark, d):
    w = streaming.windowed(_events(spark, d), "ts", "6 hours", ["count(*) as n"], ["user_id"], session=True)
    return _last(w, "complete").select("user_id", F.col("start").cast("timestamp_ntz").alias("first"), F.col("end").cast("timestamp_ntz").alias("last"), "n")


@query("select user_id, count(distinct event_type) n from events group by 1")
def stream_distinct(spark, d):
    x = streaming.distinct_stream(_events(spark, d).select("ts", "user_id", "event_type"), ["user_id", "event_type"], "ts", "4000 days")
    return _last(x, "append").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("select user_id, count(*) n, count(*) top, round(sum(value), 4) total from events group by 1")
def stream_numbered(spark, d):
    x = _last(streaming.numbered(_events(spark, d), ["user_id"], ["event_id"], "value"), "append")
    return x.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_number").alias("top"), F.round(F.max_by("running_sum", "row_number"), 4).alias("total"))


@query("""select c_custkey k, rpad(left(c_name, 12), 14, ' ') pad, left(c_name, 12) var, rpad(left(c_name, 12), 14, ' ') chr, (c_custkey % 16)::bigint hive, 'custom' stem, true digest from customer""")
def text_forms(spark, d):
    c, s = _t(spark, d, "customer"), F.left("c_name", F.lit(12))
    spark_ = lambda name, *a: call("spark", name, *a)
    whole = _t(spark, d, "lineitem").agg(call("ansi", "digest_agg", "l_quantity").alias("g"), F.percentile("l_quantity", 0.5).alias("m"))
    near = whole.select(F.abs(call("ansi", "value_at_quantile_digest", F.col("g"), 0.5) - F.col("m")) < 1).first()[0]
    return c.select(
        F.col("c_custkey").alias("k"), spark_("read_side_padding", s, 14).alias("pad"), spark_("varchar_type_write_side_check", F.concat(s, F.lit("   ")), 12).alias("var"), spark_("char_type_write_side_check", s, 14).alias("chr"), spark_("hive_bucket", 16, F.col("c_custkey").cast("int")).cast("bigint").alias("hive"),
        call("ansi", "word_stem", F.lit("customs")).alias("stem"), F.lit(near).alias("digest"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
