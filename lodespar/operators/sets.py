"""Set operations, with or without repeated rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_all(*sources: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sources)


def union_distinct(*sources: DataFrame) -> DataFrame:
    return union_all(*sources).distinct()


def intersect_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def except_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def intersect_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersectAll(b)


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)
