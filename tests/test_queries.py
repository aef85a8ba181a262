"""Every registered query against its SQL, on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from lodespar.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(name, spark, sf_dir, same):
    same(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name])


@pytest.fixture(scope="module")
def twice(spark, sf_dir, tmp_path_factory):
    """The tables with each row again under other keys, so that values tie."""
    import duckdb

    d = tmp_path_factory.mktemp("twice")
    con = duckdb.connect()
    for t, keys in (("customer", ["c_custkey"]), ("orders", ["o_orderkey", "o_custkey"]), ("lineitem", ["l_orderkey"])):
        con.execute(f"copy (select t.* replace ({', '.join(f'{k} + i * 1000000 as {k}' for k in keys)}) from range(2) r(i), '{sf_dir}/{t}.parquet' t order by i, {keys[0]}) to '{d}/{t}.parquet'")
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    con.execute("set threads = 1")
    return str(d), con


@pytest.mark.parametrize("name", ["rel_partial_states", "rel_join_left_semi_project_condition_null_aware", "ansi_aggregates"])
def test_query_with_ties(name, spark, twice):
    d, con = twice
    got, want = registry.queries()[name](spark, d).toArrow(), con.sql(registry.oracle_sql()[name]).to_arrow_table()
    names = sorted(want.column_names)
    assert sorted(map(repr, got.select(names).to_pylist())) == sorted(map(repr, want.select(names).to_pylist()))


@pytest.mark.parametrize("condition", ["v > w * 2", None])
def test_null_aware_condition(spark, condition):
    """By all pairs; a comparison of both sides needs no join of rows without a key."""
    from lodespar.operators import hash_join

    left = [(k, w) for k in (None, 1, 2, 3) for w in (None, -1.0, 0.5, 2.0, float("nan"))]
    right = [(None, 1.0, 1.0), (1, 3.0, 0.0), (2, None, 5.0), (2, 0.5, 0.5), (None, None, 0.0), (None, -3.0, 1.0)]
    l, r = spark.createDataFrame(left, "k int, w double").coalesce(1), spark.createDataFrame(right, "ok int, v double, u double").coalesce(1)
    l.createOrReplaceTempView("cl")
    r.createOrReplaceTempView("cr")
    text = condition or "w >= v"
    condition = condition or F.col("w") >= F.col("v")
    for rows in (r, r.where("ok is not null")):
        rows.createOrReplaceTempView("cr")
        got = hash_join(l, rows, ["k"], ["ok"], "left_semi_project", condition, True)
        if text in ("v > w * 2", "w >= v"):
            assert got._jdf.queryExecution().executedPlan().toString().count("BroadcastNestedLoopJoin") <= 1
        want = spark.sql(f"select k, w, max(case when {text} then if(k = ok, 2, if(k is null or ok is null, 1, 0)) end) m from cl left join cr on true group by k, w")
        assert sorted(map(repr, got.collect())) == sorted(repr(type(got.first())(k=x.k, w=x.w, match={2: True, 1: None}.get(x.m, False))) for x in want.collect())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6
    assert set(e.oracle_sql()) <= set(e.queries())
