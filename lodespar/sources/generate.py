"""Random rows of a schema, from a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, MapType, StringType, StructType, TimestampNTZType, TimestampType, _parse_datatype_string


def _value(kind: DataType, seed: int, nulls: float) -> Column:
    r = F.rand(seed)
    if isinstance(kind, BooleanType):
        out = r < 0.5
    elif isinstance(kind, (DoubleType, FloatType, DecimalType)):
        out = (F.randn(seed) * 1000).cast(kind)
    elif isinstance(kind, (StringType, BinaryType)):
        out = F.substring(F.sha2((r * 1e15).cast("string"), 256), F.lit(1), (F.rand(seed + 1) * 20).cast("int")).cast(kind)
    elif isinstance(kind, DateType):
        out = F.date_add(F.lit("2000-01-01").cast("date"), (r * 10_000).cast("int"))
    elif isinstance(kind, (TimestampType, TimestampNTZType)):
        out = F.timestamp_micros((r * 1.6e15).cast("bigint")).cast(kind)
    elif isinstance(kind, ArrayType):
        out = F.slice(F.array(*[_value(kind.elementType, seed + 10 * i + 3, nulls) for i in range(4)]), F.lit(1), (r * 5).cast("int"))
    elif isinstance(kind, MapType):
        out = F.map_from_arrays(F.array(*[F.lit(i).cast(kind.keyType) for i in range(3)]), F.array(*[_value(kind.valueType, seed + 10 * i + 4, nulls) for i in range(3)]))
    elif isinstance(kind, StructType):
        out = F.struct(*[_value(f.dataType, seed + 100 * (i + 1), nulls).alias(f.name) for i, f in enumerate(kind.fields)])
    else:
        bits = {"tinyint": 7, "smallint": 15, "int": 31}.get(kind.simpleString(), 53)
        out = ((r - 0.5) * float(2**bits)).cast(kind)
    return F.when(F.rand(seed + 2) >= nulls, out) if nulls else out


def random_rows(spark: SparkSession, schema: str, rows: int, seed: int = 0, nulls: float = 0.1, partitions: int | None = None) -> DataFrame:
    kinds = _parse_datatype_string(schema)
    return spark.range(0, rows, 1, partitions).select(*[_value(f.dataType, seed + 1000 * i, nulls).alias(f.name) for i, f in enumerate(kinds.fields)])
