import pytest
from pyspark.sql import functions as F

from lodespar.functions import call


def c(name, *args):
    return call("ansi", name, *args)


def test_digests(spark):
    d = c("construct_tdigest", F.array(*[F.lit(float(x)) for x in (3, 1, 2, 4)]), F.array(*[F.lit(x) for x in (1, 1, 1, 1)]), 1.0, 4.0)
    two = c("merge_tdigest", F.array(d, c("scale_tdigest", d, 3.0)))
    r = spark.range(1).select(
        c("value_at_quantile_digest", d, 0.5).alias("m"), c("quantile_at_value_digest", d, 2.5).alias("q"), c("quantile_at_value_digest", d, 9.0).alias("one"), c("trimmed_mean", d, 0.25, 0.75).alias("t"),
        c("destructure_tdigest", two)["count"].alias("n"), c("destructure_tdigest", two)["sum"].alias("s"), c("values_at_quantiles_digest", d, F.array(F.lit(0.0), F.lit(1.0))).alias("e"),
    ).first()
    assert (r.m, r.q, r.one, r.t, r.n, r.s, r.e) == (2.5, 0.5, 1.0, 2.5, 16, 40.0, [1.0, 4.0])


def test_distributions(spark):
    s = spark.range(1001).select(F.col("id").cast("double").alias("x")).agg(c("tdigest_agg", "x").alias("s"))
    r = s.select(c("value_at_quantile", "s", 0.5).alias("m"), c("quantile_at_value", "s", 250.0).alias("q"), c("values_at_quantiles", "s", F.array(F.lit(0.1), F.lit(0.9))).alias("v")).first()
    assert r.m == pytest.approx(500, abs=25) and r.q == pytest.approx(0.25, abs=0.03) and r.v == pytest.approx([100, 900], abs=30)


def test_sets(spark):
    a = spark.range(1000).groupBy((F.col("id") % 2).alias("k")).agg(c("approx_set", "id").alias("s"))
    r = a.agg(c("merge_hll", F.collect_list("s")).alias("m"), c("cardinality_hll", c("merge", "s")).alias("n")).select(c("cardinality_hll", "m").alias("m"), "n").first()
    assert r.m == pytest.approx(1000, rel=0.05) and r.n == pytest.approx(1000, rel=0.05)
    assert spark.range(3).agg(c("cardinality_hll", c("empty_approx_set")).alias("n")).first().n == 0


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, 8.0), ("a", None, 5.0), (None, 7, 1.0)], "k string, i int, x double")
    r = df.agg(
        c("array_agg_ordered", "i", "x").alias("o"), c("map_agg", "k", "x").alias("m"), c("multimap_agg", "k", "i").alias("mm"), c("set_agg", "i").alias("s"), c("geometric_mean", "x").alias("g"), c("max_by", "k", "x", 2).alias("mb"),
        c("min", "x", 2).alias("mn"), c("reduce_agg", "x", F.lit(0.0), lambda s, v: s + v).alias("r"), c("kurtosis", "x").alias("ku"), c("sum_data_size_for_stats", "k").alias("sz"), c("noisy_count_gaussian", "x", 0.0).alias("nc"), c("approx_most_frequent", 1, "k").alias("f"),
        c("checksum", "i").alias("ck"), c("histogram", "k").alias("h"),
    ).first()
    assert r.o == [7, 1, 2, None, 1] and r.m == {"a": 2.0, "b": 8.0} and r.mm == {"a": [1, 2, None], "b": [1]} and set(r.s) == {1, 2, 7, None} and r.g == pytest.approx(3.1697863849222267)
    assert r.mb == ["b", "a"] and r.mn == [1.0, 2.0] and r.r == 20.0 and r.ku is not None and r.sz == 4 and r.nc == 5 and r.f == {"a": 3} and r.h == {"a": 3, "b": 1}
    again = df.orderBy(F.desc("x")).agg(c("checksum", "i").alias("ck")).first()
    assert again.ck == r.ck
