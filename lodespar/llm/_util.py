"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodespar.shipping import ship  # noqa: F401

#: Bytes of text that one vectorised step takes at once; a longer text is a step of its own.
STEP_BYTES = 1 << 20

#: Rows of numbers that one file of a table with a known bound takes.
ROWS_PER_FILE = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where that is unset and all runs in one process, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), f"lodespar-{sc.applicationId}")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame, most_rows: int | None = None) -> DataFrame:
    """Materialises df in the shared folder as Parquet and reads it back: the lineage ends there.

    most_rows: a bound of its rows, where one is known; few rows go to few files.
    """
    spark = df.sparkSession
    if most_rows is not None:
        df = df.coalesce(2 + most_rows // ROWS_PER_FILE)
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Removes the files of a table made by cut(), once nothing reads it any more."""
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        remove(df.sparkSession, f)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Steps of a plan after which a second reading may give rows in other partitions.
_UNSTEADY = re.compile(r"Exchange|MapIn|FlatMap|Sample|Limit")


def steady(df: DataFrame) -> DataFrame:
    """df with rows that come in the same partitions each time it is read: itself if it is read from files without a shuffle, else a copy in the shared folder."""
    return cut(df) if _UNSTEADY.search(df._jdf.queryExecution().executedPlan().toString()) else df


def sample_texts(docs: DataFrame, picked: DataFrame, by: str, most_bytes: int) -> DataFrame:
    """The texts of picked documents, for a fit on a bounded sample.

    docs: doc_id, text. picked: doc_id, by, h and others; a bounded number of
    rows, no two of one id. Of several texts with one id the longest counts. Of
    each value of by those are kept whose texts, in the order of h, have
    most_bytes or less together.
    """
    names = picked.columns
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").withColumn("size", F.octet_length("text"))
    texts = cut(texts.groupBy(*names).agg(F.max_by("text", F.struct("size", "text")).alias("text"), F.max("size").alias("size")))
    upto = F.sum("size").over(Window.partitionBy(by).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    fits = texts.select("doc_id", upto.alias("upto")).where(F.col("upto") <= most_bytes).select("doc_id")
    return texts.join(F.broadcast(fits), "doc_id").select(*names, "text")


def trim() -> None:
    """Gives a worker's freed memory back to the system, for idle workers stay beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have none
        pass


def steps(batches: Iterator[pa.RecordBatch], column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into slices of about most bytes of the given text column; a null text counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.schema.get_field_index(column)
        col = batch.column(k)
        if col.null_count:
            batch = batch.set_column(k, column, col.fill_null(""))
            col = batch.column(k)
        sizes = pc.binary_length(col).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)
    trim()
