from pyspark.sql import functions as F

from lodespar import sources, streaming


def test_delimited_round_trip(spark, tmp_path):
    schema = "i int, s string, a array<int>, m map<string,double>, r struct<x:int,y:string>"
    rows = [(1, "x", [1, None, 3], {"a": 1.5}, (1, "q")), (None, None, None, None, None), (3, "", [], {}, (None, "z"))]
    df = spark.createDataFrame(rows, schema)
    sources.write_delimited(df, f"{tmp_path}/t")
    got = sources.read_delimited(spark, f"{tmp_path}/t", schema)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))


def test_deletes(spark, tmp_path):
    spark.range(0, 100, 1, 2).write.parquet(f"{tmp_path}/d")
    where = spark.read.parquet(f"{tmp_path}/d").select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("pos"), "id")
    got = sources.read_with_deletes(spark, f"{tmp_path}/d", where.where("id % 10 = 0").drop("id"), [spark.createDataFrame([(7,), (9,)], "id bigint")])
    assert {r.id for r in got.collect()} == {i for i in range(100) if i % 10} - {7, 9}


def test_write_with_stats(spark, tmp_path):
    df = sources.random_rows(spark, "a int, b string, c double, d array<int>", 500, seed=1)
    stats = sources.write_table(df.withColumn("p", F.col("a") % 3), f"{tmp_path}/w", partition_by=["p"], sort_by=["a"], stats=["a"])
    back = sources.read_files(spark, f"{tmp_path}/w", columns=["a", "p"])
    assert stats["rows"] == back.count() == 500 and stats["a_nulls"] == back.where("a is null").count()
    wide = sources.read_files(spark, f"{tmp_path}/w", schema="a int, missing double", row_index="at")
    assert wide.where("missing is not null").count() == 0 and wide.agg(F.max("at")).first()[0] >= 0


def test_random_rows_repeat(spark):
    a, b = (sources.random_rows(spark, "x bigint, t timestamp, m map<int,string>, s struct<u:boolean>", 50, seed=5, partitions=2).collect() for _ in range(2))
    assert a == b and any(r.x is None for r in a)


def test_windows(spark, sf_dir, same, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(f"{tmp_path}/e")
    schema = spark.read.parquet(f"{tmp_path}/e").schema
    s = streaming.read_stream(spark, f"{tmp_path}/e", schema, most_files=1)
    w = streaming.windowed(s, "ts", "1 day", ["count(*) as n"], ["event_type"])
    got: list = []
    q = w.writeStream.outputMode("complete").foreachBatch(lambda df, i: got.append(df.toArrow())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(got) == 3
    rows = spark.createDataFrame(got[-1].to_pandas()).select(F.col("start").cast("timestamp_ntz").alias("d"), "event_type", "n")
    same(rows, "select date_trunc('day', ts) d, event_type, count(*) n from events group by 1, 2")


def test_drain(spark, tmp_path):
    spark.range(30).repartition(3).write.parquet(f"{tmp_path}/r")
    seen: list[int] = []
    streaming.drain(streaming.read_stream(spark, f"{tmp_path}/r", "id bigint", most_files=1), lambda df, i: seen.append(df.count()), f"{tmp_path}/c")
    assert sum(seen) == 30 and len(seen) == 3
