"""Delimited text with nested values: fields by \\x01, items by \\x02, keys by \\x03, nulls as \\N."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, _parse_datatype_string

FIELD, ITEM, KEY, NULL = "\x01", "\x02", "\x03", r"\N"


def _read(c: Column, kind, item: str, key: str) -> Column:
    c = F.when(c != NULL, c)
    if isinstance(kind, ArrayType):
        return F.when(c == "", F.array().cast(kind)).otherwise(F.transform(F.split(c, item), lambda x: F.when(x != NULL, x)).cast(kind))
    if isinstance(kind, MapType):
        pairs = F.transform(F.split(c, item), lambda x: F.split(x, key))
        return F.when(c == "", F.create_map().cast(kind)).otherwise(F.map_from_arrays(F.transform(pairs, lambda p: p[0]), F.transform(pairs, lambda p: F.when(p[1] != NULL, p[1]))).cast(kind))
    if isinstance(kind, StructType):
        parts = F.split(c, item)
        return F.when(c.isNotNull(), F.struct(*[F.when(F.get(parts, F.lit(i)) != NULL, F.get(parts, F.lit(i))).cast(f.dataType).alias(f.name) for i, f in enumerate(kind.fields)]))
    return c.try_cast(kind)


def read_delimited(spark: SparkSession, path: str, schema: str, field: str = FIELD, item: str = ITEM, key: str = KEY, skip_header: bool = False) -> DataFrame:
    """Values that can't be read as their type are null; missing fields too. skip_header drops the first line of each file."""
    kinds = _parse_datatype_string(schema)
    lines = spark.read.text(path)
    if skip_header:  # the line at the beginning of a file is the one that a split of it begins with
        first = F.col("_metadata.file_block_start") == 0
        lines = lines.select("value", first.alias("first"), F.spark_partition_id().alias("part"), F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("n"))
        heads = lines.where("first").groupBy("path").agg(F.min("n").alias("n"))
        lines = lines.join(heads, ["path", "n"], "left_anti")  # one row per file: broadcast if small
    parts = F.split("value", _quote(field), -1)
    rows = lines.select(parts.alias("p"))
    return rows.select(*[_read(F.get("p", F.lit(i)), f.dataType, _quote(item), _quote(key)).alias(f.name) for i, f in enumerate(kinds.fields)])


def _quote(sep: str) -> str:
    return "".join(f"\\x{ord(c):02x}" for c in sep)


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NULL))


def _write(name: str, kind, item: str, key: str) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(kind, ArrayType):
        out = F.array_join(F.transform(c, _text), item)
    elif isinstance(kind, MapType):
        out = F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(_text(e["key"]), F.lit(key), _text(e["value"]))), item)
    elif isinstance(kind, StructType):
        out = F.when(c.isNotNull(), F.concat_ws(item, *[_text(c[f.name]) for f in kind.fields]))
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(NULL))


def write_delimited(df: DataFrame, path: str, mode: str = "errorifexists", field: str = FIELD, item: str = ITEM, key: str = KEY) -> None:
    line = F.concat_ws(field, *[_write(f.name, f.dataType, item, key) for f in df.schema.fields])
    df.select(line.alias("value")).write.mode(mode).text(path)
