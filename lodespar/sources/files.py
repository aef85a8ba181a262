"""Files of columns: splits, hidden columns, deletes, and tables in partitions and buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, paths: str | Sequence[str], schema: str | None = None, columns: Sequence[str] | None = None, filters: Sequence[str | Column] = (), kind: str = "parquet", row_index: str | None = None, **options) -> DataFrame:
    """Files with a given schema: columns that a file lacks are null, filters and columns reach the scan. row_index adds each row's number in its file (parquet)."""
    reader = spark.read.options(**options)
    if schema:
        reader = reader.schema(schema)
    df = reader.format(kind).load([paths] if isinstance(paths, str) else list(paths))
    if row_index:
        df = df.select("*", F.col("_metadata.row_index").alias(row_index))
    for f in filters:
        df = df.where(f)
    return df.select(*columns, *([row_index] if row_index else [])) if columns else df


def info_columns(df: DataFrame, path: str | None = "$path", size: str | None = "$file_size", modified: str | None = "$file_modified_time") -> DataFrame:
    """Adds what is known of each row's file."""
    named = (("file_path", path), ("file_size", size), ("file_modification_time", modified))
    return df.select("*", *[F.col(f"_metadata.{k}").alias(n) for k, n in named if n])


def read_with_deletes(spark: SparkSession, paths: str | Sequence[str], deletes: DataFrame, equality: Sequence[DataFrame] = ()) -> DataFrame:
    """Merge on read: drops rows listed by (file_path, pos), and rows equal to one of a table of keys (nulls are equal)."""
    base = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    names = base.columns
    df = base.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__pos"))
    df = df.join(deletes.select(F.col("file_path").alias("__path"), F.col("pos").alias("__pos")), ["__path", "__pos"], "left_anti")
    for keys in equality:
        on = F.lit(True)
        for c in keys.columns:
            on = on & df[c].eqNullSafe(keys[c])
        df = df.join(keys, on, "left_anti")
    return df.select(*names)


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), most_rows: int | None = None, stats: Sequence[str] = ()) -> dict:
    """Writes files and returns the number of rows, and per column of stats its nulls, least and largest value, gathered while writing."""
    seen = Observation()
    exprs = [F.count(F.lit(1)).alias("rows")]
    for c in stats:
        exprs += [F.count_if(F.col(c).isNull()).alias(f"{c}_nulls"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    out = df.observe(seen, *exprs)
    if partition_by:
        out = out.hint("rebalance", *partition_by)
    if sort_by:
        out = out.sortWithinPartitions(*partition_by, *sort_by)
    writer = out.write.format(kind).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if most_rows:
        writer = writer.option("maxRecordsPerFile", most_rows)
    writer.save(path)
    return seen.get


def write_partitions(df: DataFrame, table: str, partition_by: Sequence[str] = (), bucket_by: Sequence[str] = (), buckets: int = 0, sort_by: Sequence[str] = (), mode: str = "errorifexists", kind: str = "parquet") -> None:
    """A table of the catalog in partitions and sorted buckets, so that joins by the buckets need no exchange."""
    writer = df.write.format(kind).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if buckets:
        writer = writer.bucketBy(buckets, *bucket_by)
        if sort_by:
            writer = writer.sortBy(*sort_by)
    writer.saveAsTable(table)
