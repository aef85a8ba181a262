"""Functions of the user: by rows, by Arrow batches, aggregates in one step or two, tables, and rewrites."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_USER: dict[str, list[tuple[tuple[str, ...] | None, Callable[..., Column]]]] = {}


def scalar(name: str, f: Callable, returns: str, spark: SparkSession | None = None, default_nulls: bool = True) -> Callable[..., Column]:
    """f by rows, in Arrow batches. With default_nulls a null argument gives null without a call. With a session it is known to SQL by name."""

    def run(*cols: pa.Array) -> pa.Array:
        out = [None if default_nulls and None in row else f(*row) for row in zip(*[c.to_pylist() for c in cols])]
        return pa.array(out)

    udf = F.arrow_udf(run, returns)
    if spark is not None:
        spark.udf.register(name, udf)
    return overload(name, None, udf)


def vector(name: str, f: Callable[..., pa.Array], returns: str, spark: SparkSession | None = None) -> Callable[..., Column]:
    """f from Arrow arrays to an Arrow array."""
    udf = F.arrow_udf(f, returns)
    if spark is not None:
        spark.udf.register(name, udf)
    return overload(name, None, udf)


def overload(name: str, kinds: tuple[str, ...] | None, make: Callable[..., Column]) -> Callable[..., Column]:
    """Adds a form of a function for arguments of the given type names; None takes any. Later forms of the same kinds win."""
    _USER.setdefault(name, []).insert(0, (kinds, make))
    return make


def resolve(name: str, df: DataFrame, *args: Column | str) -> Column:
    """The form of a function that fits the types which the arguments have in df."""
    cs = [a if isinstance(a, Column) else F.col(a) for a in args]
    kinds = tuple(t for _, t in df.select(*[c.alias(f"a{i}") for i, c in enumerate(cs)]).dtypes)
    for wanted, make in _USER.get(name, []):
        if wanted is None or (len(wanted) == len(kinds) and all(w in ("any", k) for w, k in zip(wanted, kinds))):
            return make(*cs)
    raise LookupError(f"no {name}({', '.join(kinds)})")


def aggregate(df: DataFrame, keys: list[str], values: list[str], partial: Callable[[pa.Table], dict], merge: Callable[[list[dict]], dict], state: str, returns: str, salt: int = 32) -> DataFrame:
    """An aggregate of the user in two steps, so that no group has to fit one task.

    partial makes a state (a dict of the columns of state) of some rows of a
    group; merge makes the result (a dict of the columns of returns) of a
    group's states, at most salt of them per group.
    """
    kinds = ", ".join(f"{k} {t}" for k, t in df.select(*keys).dtypes)

    def first(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out = {k: [v.as_py()] for k, v in zip(keys, key)} | {k: [v] for k, v in partial(table.select(values)).items()}
        return pa.table(out)

    def last(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out = {k: [v.as_py()] for k, v in zip(keys, key)} | {k: [v] for k, v in merge(table.drop_columns(keys).to_pylist()).items()}
        return pa.table(out)

    salted = df.select(*keys, *values).withColumn("__salt", (F.rand(0) * salt).cast("int"))
    states = salted.groupBy(*keys, "__salt").applyInArrow(first, f"{kinds}, {state}")
    return states.groupBy(*keys).applyInArrow(last, f"{kinds}, {returns}")


def table(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], returns: str) -> DataFrame:
    """An operator of the user over the batches of each partition."""
    return df.mapInArrow(f, returns)


_REWRITES: list[Callable[[str, tuple], Column | None]] = []


def rewrite(rule: Callable[[str, tuple], Column | None]) -> None:
    """Adds a rule that sees a function's name and arguments before it is resolved, and gives another expression or None."""
    _REWRITES.append(rule)


def rewritten(name: str, *args) -> Column | None:
    """What the first rule that fits makes of a call."""
    for rule in _REWRITES:
        out = rule(name, args)
        if out is not None:
            return out
    return None


def window_function(df: DataFrame, partition: list[str], order: list[str], f: Callable[[pa.Table], pa.Array], name: str, returns: str) -> DataFrame:
    """A window function of the user: f gives one value per row of a partition, whose rows come in order. A partition must fit a task."""
    kinds = ", ".join(f"`{k}` {t}" for k, t in df.dtypes)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        return table.append_column(name, f(table))

    return df.groupBy(*partition).applyInArrow(run, f"{kinds}, `{name}` {returns}")


def table_function(spark: SparkSession, name: str, f: Callable[..., Iterator[tuple]], returns: str) -> Callable[..., DataFrame]:
    """A function of the user that gives rows from constants, in DataFrames and in SQL by name."""

    class Rows:
        def eval(self, *args):
            yield from f(*args)

    made = F.udtf(Rows, returnType=returns)
    spark.udtf.register(name, made)
    return lambda *args: made(*[F.lit(a) for a in args])
