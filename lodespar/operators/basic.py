"""Row-wise operators, sorts, limits, ranks, unnesting and exchanges."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Key = str | Column


def keys_of(spec: Iterable[Key]) -> list[Column]:
    """Sort keys: columns, or strings like "a", "a desc", "a desc nulls first". A string that names no nulls order puts nulls last."""
    out = []
    for k in spec:
        if not isinstance(k, str):
            out.append(k)
            continue
        name, *words = k.split()
        down = "desc" in [w.lower() for w in words]
        first = "first" in [w.lower() for w in words]
        c = F.col(name)
        out.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last()))
    return out


def values(spark: SparkSession, rows: Sequence, schema: str, repeat: int = 1) -> DataFrame:
    """Literal rows, each set of them repeated."""
    df = spark.createDataFrame(list(rows), schema)
    return df if repeat == 1 else df.crossJoin(F.broadcast(spark.range(repeat).select(F.lit(1).alias("__n")))).drop("__n")


def filter_rows(df: DataFrame, predicate: Key) -> DataFrame:
    return df.where(predicate)


def project(df: DataFrame, *exprs: Key) -> DataFrame:
    return df.select(*[F.expr(e) if isinstance(e, str) else e for e in exprs])


def parallel_project(df: DataFrame, groups: Sequence[Sequence[Key]]) -> DataFrame:
    """Projections given in groups; tasks run side by side anyway, so the groups are one projection."""
    return project(df, *[e for g in groups for e in g])


def assign_unique_id(df: DataFrame, name: str = "unique_id") -> DataFrame:
    return df.withColumn(name, F.monotonically_increasing_id())


def enforce_single_row(df: DataFrame) -> DataFrame:
    """The only row; one row of nulls where there is none; an error where there are more."""
    n = F.count(F.lit(1))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    one = df.agg(F.when(n > 1, F.raise_error(F.lit("more than one row"))).otherwise(F.first(row)).alias("r"))
    return one.select(*[F.col("r").getField(c).alias(c) for c in df.columns])


def order_by(df: DataFrame, keys: Iterable[Key], partial: bool = False) -> DataFrame:
    return df.sortWithinPartitions(*keys_of(keys)) if partial else df.orderBy(*keys_of(keys))


def limit(df: DataFrame, count: int, offset: int = 0) -> DataFrame:
    return (df.offset(offset) if offset else df).limit(count)


def top_n(df: DataFrame, keys: Iterable[Key], count: int) -> DataFrame:
    return df.orderBy(*keys_of(keys)).limit(count)


def row_number(df: DataFrame, partition: Sequence[Key], name: str | None = "row_number", most: int | None = None) -> DataFrame:
    """Numbers rows of a partition in no given order; with most, keeps that many. name None leaves the number out."""
    w = Window.partitionBy(*partition).orderBy(F.lit(0))
    out = df.withColumn("__rn", F.row_number().over(w).cast("bigint"))
    out = out.where(F.col("__rn") <= most) if most is not None else out
    return out.withColumnRenamed("__rn", name) if name else out.drop("__rn")


def top_n_row_number(df: DataFrame, partition: Sequence[Key], keys: Iterable[Key], count: int, name: str | None = None, rank: str = "row_number") -> DataFrame:
    """The first rows of each partition by row_number, rank or dense_rank. Catalyst keeps no more than those per task before the shuffle."""
    w = Window.partitionBy(*partition).orderBy(*keys_of(keys))
    fn = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[rank]
    out = df.withColumn("__rn", fn().over(w)).where(F.col("__rn") <= count)
    return out.withColumn(name, F.col("__rn").cast("bigint")).drop("__rn") if name else out.drop("__rn")


def unnest(df: DataFrame, columns: Sequence[str], replicate: Sequence[str] = (), ordinality: str | None = None, marker: str | None = None) -> DataFrame:
    """Unnests array and map columns side by side; shorter ones are padded by null.

    An array c gives c_e, a map c gives c_k and c_v. ordinality counts from 1.
    With marker, rows whose columns are all empty or null stay, with marker
    false and null values.
    """
    from pyspark.sql.types import MapType

    kinds = {c: df.schema[c].dataType for c in columns}
    lists = {c: F.map_entries(c) if isinstance(kinds[c], MapType) else F.col(c) for c in columns}
    lists = {c: F.coalesce(x, F.array().cast(f"array<{'struct<key:' + kinds[c].keyType.simpleString() + ',value:' + kinds[c].valueType.simpleString() + '>' if isinstance(kinds[c], MapType) else kinds[c].elementType.simpleString()}>")) for c, x in lists.items()}
    zipped = F.arrays_zip(*[x.alias(f"u{i}") for i, x in enumerate(lists.values())])
    flat = df.select(*replicate, zipped.alias("__z"))
    explode = F.posexplode_outer if marker else F.posexplode
    flat = flat.select(*replicate, explode("__z").alias("__pos", "__row"))
    fields = flat.schema["__row"].dataType.fieldNames()
    out: list[Column] = [F.col(c) for c in replicate]
    for f, c in zip(fields, columns):
        x = F.col("__row").getField(f)
        out += [x.getField("key").alias(f"{c}_k"), x.getField("value").alias(f"{c}_v")] if isinstance(kinds[c], MapType) else [x.alias(f"{c}_e")]
    if ordinality:
        out.append((F.col("__pos") + 1).cast("bigint").alias(ordinality))
    if marker:
        out.append(F.col("__pos").isNotNull().alias(marker))
    return flat.select(*out)


def local_partition(df: DataFrame, keys: Sequence[Key] = (), n: int | None = None) -> DataFrame:
    """By hash of keys, or round robin without; n = 1 gathers."""
    if n == 1:
        return df.coalesce(1)
    return df.repartition(*([n] if n else []), *keys) if keys or n else df


def partitioned_output(df: DataFrame, kind: str, keys: Sequence[Key] = (), n: int | None = None) -> DataFrame:
    """kind: hash, range, round_robin, gather or broadcast."""
    if kind == "broadcast":
        return F.broadcast(df)
    if kind == "gather":
        return df.coalesce(1)
    if kind == "range":
        return df.repartitionByRange(*([n] if n else []), *keys)
    return df.repartition(*([n] if n else []), *(keys if kind == "hash" else ()))


def scale_writers(df: DataFrame, *keys: Key) -> DataFrame:
    """Lets adaptive execution choose the number of writers by the volume of data."""
    return df.hint("rebalance", *keys)


def sorted_merge(sources: Sequence[DataFrame], keys: Iterable[Key]) -> DataFrame:
    return reduce(DataFrame.unionByName, sources).orderBy(*keys_of(keys))


def callback_sink(df: DataFrame, callback: Callable) -> None:
    """Calls back with an iterator of each partition's rows, on the executors."""
    df.foreachPartition(callback)
