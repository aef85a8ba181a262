"""Joins of all kinds, by keys, by conditions, by ranges and by time."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespar.functions import native

#: The kinds of joins.
KINDS = ("inner", "left", "right", "full", "left_semi_filter", "right_semi_filter", "left_semi_project", "right_semi_project", "anti")


def _on(left: DataFrame, right: DataFrame, lk: Sequence[str], rk: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[a] == right[b] for a, b in zip(lk, rk)])


def hash_join(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], kind: str = "inner", condition: Column | str | None = None, null_aware: bool = False, match: str = "match", hint: str | None = None) -> DataFrame:
    """Join by equal keys and, as part of ON, a condition over both sides' columns (whose names must differ).

    right_semi_* give the right side's rows. semi_project gives every row and a
    boolean. null_aware gives the semantics of IN and NOT IN: the boolean is
    null where the row's key is null and the other side has rows, or where
    nothing matches and the other side has a null key; anti keeps rows whose
    boolean is false.
    """
    if kind.startswith("right_semi"):
        return hash_join(right, left, right_keys, left_keys, kind.replace("right", "left"), condition, null_aware, match, hint)
    if hint:
        right = right.hint(hint)
    on = _on(left, right, left_keys, right_keys)
    if condition is not None:
        on = on & (F.expr(condition) if isinstance(condition, str) else condition)
    if kind in ("inner", "left", "right", "full"):
        return left.join(right, on, kind)
    if kind == "left_semi_filter":
        return left.join(right, on, "left_semi")
    if kind == "anti" and not null_aware:
        return left.join(right, on, "left_anti")
    if kind not in ("left_semi_project", "anti"):
        raise ValueError(kind)
    marked = _existence(left, right, left_keys, right_keys, condition, null_aware, match)
    return marked if kind == "left_semi_project" else marked.where(~F.col(match)).drop(match)


_ARITHMETIC = {"Add", "Subtract", "Multiply", "Divide", "UnaryMinus", "Cast", "Literal", "AttributeReference"}
_COMPARE = {"GreaterThan": (F.max, "__gt__"), "GreaterThanOrEqual": (F.max, "__ge__"), "LessThan": (F.min, "__lt__"), "LessThanOrEqual": (F.min, "__le__")}
_MIRROR = {"GreaterThan": "LessThan", "GreaterThanOrEqual": "LessThanOrEqual", "LessThan": "GreaterThan", "LessThanOrEqual": "GreaterThanOrEqual"}


def _plain(e) -> bool:
    """Whether an expression is arithmetic over columns."""
    inner = e.children()
    return e.getClass().getSimpleName() in _ARITHMETIC and all(_plain(inner.apply(i)) for i in range(inner.size()))


def _bound(condition: Column, left: DataFrame, right: DataFrame) -> tuple[Callable, Callable[[Column], Column], Column] | None:
    """Of a comparison between arithmetic over each side's columns: the aggregate of the right side's value that decides whether any row of it meets the comparison, the test of its result, and the value."""
    plan = lambda df: df._jdf.queryExecution().analyzed()
    e = plan(left.join(right, condition)).condition().get()
    kind = e.getClass().getSimpleName()
    if kind not in _COMPARE:
        return None
    a, b = e.children().apply(0), e.children().apply(1)
    l, r = plan(left).outputSet(), plan(right).outputSet()
    if a.references().subsetOf(l) and b.references().subsetOf(r):
        a, b, kind = b, a, _MIRROR[kind]
    if not (_plain(a) and _plain(b) and a.references().subsetOf(r) and b.references().subsetOf(l)):
        return None
    f, op = _COMPARE[kind]
    return f, lambda v: getattr(v, op)(native._column(b)), native._column(a)


def _existence(left, right, lk, rk, condition, null_aware, match) -> DataFrame:
    if condition is None:
        keys = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(rk)]).distinct().withColumn("__hit", F.lit(True))
        out = left.join(keys, reduce(lambda a, b: a & b, [left[a] == keys[f"__k{i}"] for i, a in enumerate(lk)]), "left")
        out = out.withColumn(match, F.col("__hit").isNotNull()).drop("__hit", *[f"__k{i}" for i in range(len(rk))])
        if not null_aware:
            return out
        # one row: whether there are rows, and rows with a null key
        some_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in rk])
        flags = right.agg((F.count(F.lit(1)) > 0).alias("__rows"), F.coalesce(F.bool_or(some_null), F.lit(False)).alias("__nulls"))
        own_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in lk])
        out = out.join(F.broadcast(flags))
        unknown = ~F.col(match) & ((own_null & F.col("__rows")) | F.col("__nulls"))
        return out.withColumn(match, F.when(unknown, F.lit(None)).otherwise(F.col(match))).drop("__rows", "__nulls")
    tagged = left.withColumn("__id", F.monotonically_increasing_id())
    cond = F.expr(condition) if isinstance(condition, str) else condition
    equal = reduce(lambda a, b: a & b, [tagged[a] == right[b] for a, b in zip(lk, rk)])
    hits = tagged.join(right, equal & cond).select("__id").withColumn("__hit", F.lit(True))
    bound = _bound(cond, left, right) if null_aware and len(lk) == 1 else None
    if bound:
        # one row: the value that decides for all rows of the other side, and for those with a null key
        f, holds, value = bound
        flags = right.select(value.alias("__v"), F.col(rk[0]).isNull().alias("__n")).agg(f("__v").alias("__all"), f(F.when(F.col("__n"), F.col("__v"))).alias("__nulls"))
        out = tagged.join(hits.distinct(), "__id", "left").join(F.broadcast(flags))
        unknown = holds(F.when(F.col(lk[0]).isNull(), F.col("__all")).otherwise(F.col("__nulls")))
        return out.withColumn(match, F.when(F.col("__hit"), True).when(unknown, F.lit(None).cast("boolean")).otherwise(False)).select(*left.columns, match)
    if null_aware:
        # a null key on either side leaves the row unknown where the condition holds: only rows with a null key meet the other side without one
        loose = reduce(lambda a, b: a & b, [F.coalesce(tagged[a] == right[b], F.lit(True)) for a, b in zip(lk, rk)])
        no_left, no_right = (reduce(lambda a, b: a | b, [side[k].isNull() for k in keys]) for side, keys in ((tagged, lk), (right, rk)))
        unknown = lambda l, r: l.join(r, loose & cond).select("__id").withColumn("__hit", F.lit(False))
        hits = hits.unionAll(unknown(tagged.where(no_left), right)).unionAll(unknown(tagged.where(~no_left), right.where(no_right)))
    hits = hits.groupBy("__id").agg(F.max("__hit").alias("__hit"))
    value = F.when(F.col("__hit"), True).when(F.col("__hit").isNull(), False)
    return tagged.join(hits, "__id", "left").withColumn(match, value).drop("__id", "__hit").select(*left.columns, match)


def merge_join(left, right, left_keys, right_keys, kind: str = "inner", condition=None, null_aware: bool = False) -> DataFrame:
    """The same rows by a sort-merge join; tables bucketed and sorted by the keys need no exchange."""
    return hash_join(left, right, left_keys, right_keys, kind, condition, null_aware, hint="merge")


def nested_loop_join(left: DataFrame, right: DataFrame, condition: Column | str | None = None, kind: str = "inner", match: str = "match") -> DataFrame:
    """Join by any condition."""
    cond = F.expr(condition) if isinstance(condition, str) else condition
    if kind == "left_semi_project":
        tagged = left.withColumn("__id", F.monotonically_increasing_id())
        pairs = tagged.join(right, cond) if cond is not None else tagged.crossJoin(right)
        hits = pairs.select("__id").distinct().withColumn("__hit", F.lit(True))
        return tagged.join(hits, "__id", "left").withColumn(match, F.col("__hit").isNotNull()).select(*left.columns, match)
    if cond is None:
        return left.crossJoin(right) if kind == "inner" else left.join(right, F.lit(True), kind)
    return left.join(right, cond, kind)


def cross_join(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right)


def index_lookup_join(left: DataFrame, index: DataFrame, left_keys: Sequence[str], index_keys: Sequence[str], kind: str = "inner", conditions: Sequence[Column | str] = (), marker: str | None = None) -> DataFrame:
    """Looks each row's key up in an indexed table, under further conditions (between, array_contains). Spark chooses broadcast or shuffle by the index's size."""
    on = _on(left, index, left_keys, index_keys)
    for c in conditions:
        on = on & (F.expr(c) if isinstance(c, str) else c)
    if marker:
        index = index.withColumn(marker, F.lit(True))
    out = left.join(index, on, kind)
    return out.withColumn(marker, F.col(marker).isNotNull()) if marker else out


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, equal: Sequence[tuple[str, str]] = (), kind: str = "inner") -> DataFrame:
    """Rows with low <= point <= high (and equal keys), as an equi-join of bins of the given width.

    A range stands in each bin that it touches; choose width near the ranges'
    usual length. Null or reversed ranges match nothing. kind is inner, left,
    left_semi or left_anti, which keep the points; or right or full, which give
    each range without a point once too.
    """
    if kind not in ("inner", "left", "left_semi", "left_anti", "right", "full"):
        raise ValueError(kind)
    if kind in ("right", "full"):
        numbered = ranges.withColumn("__range", F.monotonically_increasing_id())
        left_kind = "inner" if kind == "right" else "left"
        met = range_join(points, numbered, point, low, high, width, equal, left_kind)
        alone = numbered.join(met.where("__range is not null").select("__range").distinct(), "__range", "left_anti").drop("__range")
        return met.drop("__range").unionByName(alone, allowMissingColumns=True)
    lo, hi = F.floor(F.col(low) / F.lit(width)).cast("bigint"), F.floor(F.col(high) / F.lit(width)).cast("bigint")
    binned = ranges.where(F.col(low) <= F.col(high)).withColumn("__bin", F.explode(F.sequence(lo, hi)))
    left = points.withColumn("__at", F.floor(F.col(point) / F.lit(width)).cast("bigint"))
    on = (F.col("__at") == F.col("__bin")) & (F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))
    for a, b in equal:
        on = on & (left[a] == binned[b])
    return left.join(binned, on, kind).drop("__at", "__bin")


def as_of_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: Sequence[str], columns: Sequence[str], prefix: str = "asof_") -> DataFrame:
    """For each left row the values of the last right row of the same key at or before its time, by one sort of both sides' union."""
    payload = F.struct(*[F.col(c).alias(c) for c in columns], F.col(right_time).alias("__t"))
    l = left.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)], F.col(left_time).alias("__time"), F.lit(1).alias("__side"), F.struct(*[F.col(c) for c in left.columns]).alias("__row"))  # noqa: E741
    r = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)], F.col(right_time).alias("__time"), F.lit(0).alias("__side"), payload.alias("__value"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*[f"__k{i}" for i in range(len(by))]).orderBy("__time", "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__value", F.last("__value", ignorenulls=True).over(w)).where("__side = 1")
    return out.select("__row.*", *[F.col("__value").getField(c).alias(prefix + c) for c in columns])
