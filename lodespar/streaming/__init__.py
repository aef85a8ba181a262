"""Streams: incremental batches, event-time windows, and keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", most_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", most_files) if most_files else reader).load(path)


def windowed(df: DataFrame, time: str, size: str, aggs: Sequence[str | Column], keys: Sequence[str] = (), slide: str | None = None, late: str | None = None, session: bool = False) -> DataFrame:
    """Tumbling, sliding or session windows of event time; rows later than the watermark are dropped. Gives start, end, keys and aggregates."""
    if late:
        df = df.withWatermark(time, late)
    w = F.session_window(time, size) if session else F.window(time, size, slide) if slide else F.window(time, size)
    out = df.groupBy(w.alias("w"), *keys).agg(*[F.expr(a) if isinstance(a, str) else a for a in aggs])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in out.columns if c != "w"])


def distinct_stream(df: DataFrame, keys: Sequence[str], time: str, late: str) -> DataFrame:
    """The first row of each key, with state kept as long as the watermark allows repeats."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows of a stream with their number and the running sum of a value by key, in the order of each batch; the two numbers by key are the state."""
    kinds = ", ".join(f"`{k}` {t}" for k, t in df.dtypes)

    def run(key, parts, state):
        import pandas as pd

        n, total = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(parts)).sort_values(list(order))
        rows["row_number"] = range(n + 1, n + 1 + len(rows))
        rows["running_sum"] = total + rows[value].astype(float).fillna(0.0).cumsum()
        state.update((n + len(rows), float(rows["running_sum"].iloc[-1])))
        yield rows

    return df.groupBy(*keys).applyInPandasWithState(run, f"{kinds}, row_number bigint, running_sum double", "n bigint, total double", "append", "NoTimeout")


def drain(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs all that is there in batches, each in full before the next, and stops."""
    query = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append", kind: str = "parquet", available_now: bool = True) -> StreamingQuery:
    w = df.writeStream.format(kind).outputMode(mode).option("checkpointLocation", checkpoint).option("path", path)
    return (w.trigger(availableNow=True) if available_now else w).start()


def cursor(df: DataFrame) -> Iterator:
    """Results one partition at a time."""
    return df.toLocalIterator()
