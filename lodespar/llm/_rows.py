"""Tables by row number, of which a task reads just the part of its own rows.

A large table whose rows are numbered by monotonically_increasing_id() (see
_util.steady) can be filtered, or get a few numbers beside some rows, without a
shuffle of its own columns: the numbers are written in slices of
``1 << (SPAN - 33)`` partitions of the table, and a task opens those slices that
its rows fall into.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _util

#: Bits of a row number below its slice; 33 are the number within the partition.
SPAN = 33 + 4
#: Slices that a worker process keeps open.
OPEN = 4

_open: dict[tuple[str, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _slice(folder: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers in rising order, and where each one's values end among the values after them."""
    if (folder, k) not in _open:
        while len(_open) >= OPEN:
            del _open[next(iter(_open))]
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        files = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/slice={k}", allow_not_found=True)) if f.path.endswith(".parquet")]
        tables = []
        for path in files:
            with fs.open_input_file(path) as f:
                tables.append(pq.ParquetFile(f).read(columns=["row", "to"]))
        if not tables:
            none = np.zeros(0, np.int64)
            return _open.setdefault((folder, k), (none, none, none))
        table = pa.concat_tables(tables).sort_by("row")
        to = table.column("to").combine_chunks()
        _open[folder, k] = (table.column("row").to_numpy(), np.cumsum(np.asarray(to.value_lengths())), to.flatten().to_numpy())
    return _open[folder, k]


def find_rows(folder: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row whether it is in the table, how many values it has there, and all these values in a row."""
    hit, size, values = np.zeros(len(rows), bool), np.zeros(len(rows), np.int64), []
    order = np.argsort(rows, kind="stable")
    for k in np.unique(rows >> SPAN).tolist():
        keys, ends, flat = _slice(folder, k)
        at = order[np.searchsorted(rows[order], k << SPAN) : np.searchsorted(rows[order], (k + 1) << SPAN)]
        if not len(keys):
            continue
        pos = np.minimum(np.searchsorted(keys, rows[at]), len(keys) - 1)
        found = keys[pos] == rows[at]
        at, pos = at[found], pos[found]
        hit[at] = True
        size[at] = ends[pos] - np.where(pos > 0, ends[pos - 1], 0)
        values.append((at, flat, ends[pos] - size[at]))
    total = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(total[-1], np.int64)
    for at, flat, begin in values:
        n = size[at]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(total[at], n) + inner] = flat[np.repeat(begin, n) + inner]
    return hit, total, out


class RowTable:
    """df: row (no two equal), to (array of bigint, neither null nor with nulls)."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        _util.ship(self.spark)
        self.path = f"{_util.shared_dir(self.spark).rstrip('/')}/rows-{uuid.uuid4().hex}"
        sliced = df.select("row", "to", F.shiftright("row", SPAN).alias("slice"))
        sliced.repartition("slice").sortWithinPartitions("slice", "row").write.partitionBy("slice").parquet(self.path)

    def get(self, row: Column) -> Column:
        """The values of a row; null where it isn't in the table."""
        folder = self.path

        def run(rows: pa.Array) -> pa.Array:
            hit, total, values = find_rows(folder, rows.to_numpy(zero_copy_only=False))
            return pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), pa.array(values), mask=pa.array(~hit))

        return F.arrow_udf(run, "array<bigint>").asNondeterministic()(row)

    def has(self, row: Column) -> Column:
        folder = self.path

        def run(rows: pa.Array) -> pa.Array:
            return pa.array(find_rows(folder, rows.to_numpy(zero_copy_only=False))[0])

        return F.arrow_udf(run, "boolean").asNondeterministic()(row)

    def drop(self) -> None:
        """Removes the files, once nothing reads them any more."""
        _util.remove(self.spark, self.path)
