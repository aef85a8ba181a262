from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "3g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same(duck):
    """Asserts that a DataFrame and a query for DuckDB give the same rows."""

    def text(v):
        return repr(v.item() if hasattr(v, "item") else v)

    def rows(t):
        names = sorted(t.column_names)
        return names, sorted(tuple(map(text, r)) for r in zip(*[t.column(c).to_pylist() for c in names]))

    def check(df, sql):
        b = duck.sql(sql).to_arrow_table()
        assert rows(df.toArrow()) == rows(b)

    return check
