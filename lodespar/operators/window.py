"""Window functions, with frames whose bounds may be columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .basic import Key, keys_of


def window(df: DataFrame, partition: Sequence[Key], keys: Sequence[Key], functions: dict[str, Column], rows: tuple[int | None, int | None] | None = None, range_: tuple | None = None) -> DataFrame:
    """Adds functions over one window. rows and range_ are (start, end), None for unbounded, negative for preceding."""
    w = Window.partitionBy(*partition)
    if keys:
        w = w.orderBy(*keys_of(keys))
    edge = lambda f: (Window.unboundedPreceding if f[0] is None else f[0], Window.unboundedFollowing if f[1] is None else f[1])
    if rows is not None:
        w = w.rowsBetween(*edge(rows))
    if range_ is not None:
        w = w.rangeBetween(*edge(range_))
    return df.select("*", *[f.over(w).alias(n) for n, f in functions.items()])


#: Rows of a partition whose values are gathered together for frames.
RUN = 256


def column_frame(df: DataFrame, partition: Sequence[str], keys: Sequence[Key], value: str, start: Column, end: Column, fn: Callable[[Column], Column], name: str) -> DataFrame:
    """fn of the array of values in rows start..end around each row; start and end are columns of offsets (negative: preceding).

    Spark has no such frames. Rows are numbered, values are gathered in runs of
    RUN rows, and each row meets the runs that its frame touches, so what a
    task holds for a row is its frame, not its partition.
    """
    parts = [f"__p{i}" for i in range(len(partition))]
    by = [F.col(p).alias(n) for p, n in zip(partition, parts)]
    w = Window.partitionBy(*partition).orderBy(*keys_of(keys))
    x = df.withColumn("__rn", F.row_number().over(w).cast("bigint")).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*partition)))
    x = x.withColumn("__lo", F.greatest(F.col("__rn") + start, F.lit(1))).withColumn("__hi", F.least(F.col("__rn") + end, F.col("__n")))
    run = lambda c: F.floor((F.col(c) - 1) / RUN)
    runs = x.select(*by, "__rn", F.struct("__rn", F.col(value).alias("x")).alias("__e")).groupBy(*parts, run("__rn").alias("__run")).agg(F.sort_array(F.collect_list("__e")).alias("__values"))
    need = x.where("__hi >= __lo").select(*by, "__rn", "__lo", "__hi", F.explode(F.sequence(run("__lo"), run("__hi"))).alias("__run"))
    on = reduce(lambda a, b: a & b, [need[p].eqNullSafe(runs[p]) for p in parts], need["__run"] == runs["__run"])
    inside = F.filter("__values", lambda e: (e["__rn"] >= F.col("__lo")) & (e["__rn"] <= F.col("__hi")))
    met = need.join(runs, on).select(*[need[p] for p in parts], need["__rn"], inside.alias("__part")).groupBy(*parts, "__rn").agg(F.sort_array(F.flatten(F.collect_list("__part"))).alias("__frame"))
    met = met.withColumnRenamed("__rn", "__at")
    back = reduce(lambda a, b: a & b, [x[p].eqNullSafe(met[n]) for p, n in zip(partition, parts)], x["__rn"] == met["__at"])
    frame = F.coalesce(met["__frame"], F.array().cast(met.schema["__frame"].dataType))
    return x.join(met, back, "left").select(*[x[c] for c in df.columns], fn(F.transform(frame, lambda e: e["x"])).alias(name))


def offset_by(df: DataFrame, partition: Sequence[str], keys: Sequence[Key], value: str, offset: Column, name: str, default: Column | None = None) -> DataFrame:
    """lag by a column of offsets (negative: lead), as a join of row numbers. default stands where the offset leaves the partition; a null offset gives null."""
    w = Window.partitionBy(*partition).orderBy(*keys_of(keys))
    x = df.withColumn("__rn", F.row_number().over(w)).withColumn("__want", F.col("__rn") - offset)
    y = x.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(partition)], F.col("__rn").alias("__n"), F.col(value).alias("__v"))
    on = x["__want"] == y["__n"]
    for i, p in enumerate(partition):
        on = on & x[p].eqNullSafe(y[f"__p{i}"])
    out = x.join(y, on, "left")
    got = F.col("__v") if default is None else F.when(F.col("__n").isNull() & F.col("__want").isNotNull(), default).otherwise(F.col("__v"))
    return out.withColumn(name, got).select(*df.columns, name)


def ntile_by(df: DataFrame, partition: Sequence[str], keys: Sequence[Key], buckets: Column, name: str) -> DataFrame:
    """ntile with a column of numbers of buckets."""
    w = Window.partitionBy(*partition).orderBy(*keys_of(keys))
    rn = F.row_number().over(w).cast("bigint") - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(*partition))
    size, more = F.floor(n / buckets), n % buckets
    inside = F.when(rn < more * (size + 1), F.floor(rn / (size + 1))).otherwise(more + F.floor((rn - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return df.withColumn(name, F.when(buckets > 0, inside + 1).cast("bigint"))
