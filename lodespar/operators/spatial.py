"""Joins of geometries by a predicate, as an equi-join of grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespar.functions import call


def _celled(df: DataFrame, shape: str, size: float, margin: float, tag: str) -> DataFrame:
    edge = lambda n: call("ansi", n, shape)
    boxed = df.withColumn(f"__{tag}x0", edge("ST_XMin") - margin).withColumn(f"__{tag}y0", edge("ST_YMin") - margin).withColumn(f"__{tag}x1", edge("ST_XMax") + margin).withColumn(f"__{tag}y1", edge("ST_YMax") + margin)
    at = lambda c: F.floor(F.col(c) / size).cast("bigint")
    boxed = boxed.where(F.col(f"__{tag}x0").isNotNull())
    return boxed.withColumn(f"__{tag}cx", F.explode(F.sequence(at(f"__{tag}x0"), at(f"__{tag}x1")))).withColumn(f"__{tag}cy", F.explode(F.sequence(at(f"__{tag}y0"), at(f"__{tag}y1"))))


def spatial_join(left: DataFrame, right: DataFrame, left_shape: str, right_shape: str, predicate: str = "ST_Intersects", size: float = 1.0, within: float | None = None, kind: str = "inner") -> DataFrame:
    """Pairs of rows whose shapes (well-known binary) meet a predicate; with within, those at most so far apart. kind: inner or left.

    A shape stands in each cell of the grid that its box touches; choose size
    near the boxes' usual extent. A pair counts in the one cell where the lower
    corner of both boxes' overlap lies, so nothing has to be made distinct.
    Null and empty shapes match nothing.
    """
    names = left.columns
    tagged = left.withColumn("__id", F.monotonically_increasing_id()) if kind == "left" else left
    l, r = _celled(tagged, left_shape, size, within or 0.0, "l"), _celled(right, right_shape, size, 0.0, "r")  # noqa: E741
    col = F.col
    boxes = (col("__lx0") <= col("__rx1")) & (col("__rx0") <= col("__lx1")) & (col("__ly0") <= col("__ry1")) & (col("__ry0") <= col("__ly1"))
    corner = (F.floor(F.greatest("__lx0", "__rx0") / size) == col("__lcx")) & (F.floor(F.greatest("__ly0", "__ry0") / size) == col("__lcy"))
    near = l.join(r, (col("__lcx") == col("__rcx")) & (col("__lcy") == col("__rcy")) & boxes & corner)
    exact: Column = call("ansi", "ST_Distance", left_shape, right_shape) <= within if within is not None else call("ansi", predicate, left_shape, right_shape)
    hits = near.where(exact)
    if kind == "inner":
        return hits.select(*names, *right.columns)
    found = hits.select("__id", *right.columns)
    return tagged.join(found, "__id", "left").select(*names, *right.columns)
