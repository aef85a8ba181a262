"""Plans built step by step, each step a DataFrame; strings are SQL expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from lodespar import operators as O
from lodespar.sources import read_files, tpch_table, write_table


class Plan:
    """A chain of operators. Every method returns a new plan; frame() gives the DataFrame."""

    def __init__(self, spark: SparkSession, df: DataFrame | None = None):
        self.spark, self._df = spark, df

    def _to(self, df: DataFrame) -> Plan:
        return Plan(self.spark, df)

    def frame(self) -> DataFrame:
        if self._df is None:
            raise ValueError("the plan has no source")
        return self._df

    # sources

    def table_scan(self, paths: str | Sequence[str], schema: str | None = None, columns: Sequence[str] | None = None, aliases: dict[str, str] | None = None, filters: Sequence[str] = (), remaining_filter: str | None = None, row_index: str | None = None, kind: str = "parquet") -> Plan:
        df = read_files(self.spark, paths, schema, None, filters, kind, row_index)
        if remaining_filter:
            df = df.where(remaining_filter)
        if columns:
            df = df.select(*columns, *([row_index] if row_index else []))
        for new, old in (aliases or {}).items():
            df = df.withColumnRenamed(old, new)
        return self._to(df)

    def values(self, rows: Sequence, schema: str, repeat: int = 1) -> Plan:
        return self._to(O.values(self.spark, rows, schema, repeat))

    def tpch_gen(self, table: str, columns: Sequence[str] | None = None, scale: float = 0.01, seed: int = 0, partitions: int | None = None) -> Plan:
        df = tpch_table(self.spark, table, scale, seed, partitions)
        return self._to(df.select(*columns) if columns else df)

    def arrow(self, table) -> Plan:
        return self._to(self.spark.createDataFrame(table))

    def sql(self, text: str, **views: Plan) -> Plan:
        for name, p in views.items():
            p.frame().createOrReplaceTempView(name)
        return self._to(self.spark.sql(text))

    # rows

    def filter(self, predicate: str | Column) -> Plan:
        return self._to(O.filter_rows(self.frame(), predicate))

    def project(self, exprs: Sequence[str | Column]) -> Plan:
        return self._to(O.project(self.frame(), *exprs))

    def parallel_project(self, groups: Sequence[Sequence[str]]) -> Plan:
        return self._to(O.parallel_project(self.frame(), groups))

    def assign_unique_id(self, name: str = "unique_id") -> Plan:
        return self._to(O.assign_unique_id(self.frame(), name))

    def enforce_single_row(self) -> Plan:
        return self._to(O.enforce_single_row(self.frame()))

    def unnest(self, columns: Sequence[str], replicate: Sequence[str] = (), ordinality: str | None = None, marker: str | None = None) -> Plan:
        return self._to(O.unnest(self.frame(), columns, replicate, ordinality, marker))

    # groups

    def aggregate(self, keys: Sequence[str] = (), aggs: Sequence[str] = ()) -> Plan:
        return self._to(O.aggregate(self.frame(), keys, aggs))

    def streaming_aggregate(self, keys: Sequence[str], aggs: Sequence[str]) -> Plan:
        return self._to(O.streaming_aggregate(self.frame(), keys, aggs))

    def group_id(self, sets: Sequence[Sequence[str]], inputs: Sequence[str] = (), name: str = "group_id") -> Plan:
        return self._to(O.group_id(self.frame(), sets, inputs, name))

    def expand(self, projections, names: Sequence[str]) -> Plan:
        return self._to(O.expand(self.frame(), projections, names))

    def mark_distinct(self, keys: Sequence[str], name: str = "is_distinct") -> Plan:
        return self._to(O.mark_distinct(self.frame(), keys, name))

    # order

    def order_by(self, keys: Iterable[str], partial: bool = False) -> Plan:
        return self._to(O.order_by(self.frame(), keys, partial))

    def top_n(self, keys: Iterable[str], count: int) -> Plan:
        return self._to(O.top_n(self.frame(), keys, count))

    def limit(self, count: int, offset: int = 0) -> Plan:
        return self._to(O.limit(self.frame(), count, offset))

    def row_number(self, partition: Sequence[str], name: str | None = "row_number", most: int | None = None) -> Plan:
        return self._to(O.row_number(self.frame(), partition, name, most))

    def top_n_row_number(self, partition: Sequence[str], keys: Iterable[str], count: int, name: str | None = None) -> Plan:
        return self._to(O.top_n_row_number(self.frame(), partition, keys, count, name))

    def window(self, partition: Sequence[str], keys: Sequence[str], functions: dict[str, Column], rows=None, range_=None) -> Plan:
        return self._to(O.window(self.frame(), partition, keys, functions, rows, range_))

    # joins

    def hash_join(self, left_keys: Sequence[str], right_keys: Sequence[str], build: Plan, output: Sequence[str] | None = None, filter: str | None = None, kind: str = "inner", null_aware: bool = False) -> Plan:
        df = O.hash_join(self.frame(), build.frame(), left_keys, right_keys, kind, filter, null_aware)
        return self._to(df.select(*output) if output else df)

    def merge_join(self, left_keys: Sequence[str], right_keys: Sequence[str], right: Plan, output: Sequence[str] | None = None, filter: str | None = None, kind: str = "inner") -> Plan:
        df = O.merge_join(self.frame(), right.frame(), left_keys, right_keys, kind, filter)
        return self._to(df.select(*output) if output else df)

    def nested_loop_join(self, right: Plan, condition: str | None = None, output: Sequence[str] | None = None, kind: str = "inner") -> Plan:
        df = O.nested_loop_join(self.frame(), right.frame(), condition, kind)
        return self._to(df.select(*output) if output else df)

    def index_lookup_join(self, left_keys: Sequence[str], index_keys: Sequence[str], index: Plan, output: Sequence[str] | None = None, kind: str = "inner", conditions: Sequence[str] = ()) -> Plan:
        df = O.index_lookup_join(self.frame(), index.frame(), left_keys, index_keys, kind, conditions)
        return self._to(df.select(*output) if output else df)

    # exchanges and sinks

    def sorted_merge(self, keys: Sequence[str], *sources: Plan) -> Plan:
        return self._to(O.sorted_merge([self.frame(), *[s.frame() for s in sources]], keys))

    def partitioned_output(self, kind: str, keys: Sequence[str] = (), n: int | None = None) -> Plan:
        return self._to(O.partitioned_output(self.frame(), kind, keys, n))

    def table_write(self, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), stats: Sequence[str] = ()) -> dict:
        return write_table(self.frame(), path, kind, mode, partition_by, sort_by, stats=stats)

    def sink(self, callback: Callable) -> None:
        O.callback_sink(self.frame(), callback)

    def rows(self):
        """A cursor over the results, a partition at a time."""
        return self.frame().toLocalIterator()

    def explain(self) -> None:
        self.frame().explain("formatted")
