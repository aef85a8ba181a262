"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _util


class Union:
    """Sets of the numbers below n, joined in memory."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def components(links: DataFrame, most_links: int | None = None) -> DataFrame:
    """links: a, b (long, not null). Returns node, component: the smallest node that is reachable.

    Alternates large-star and small-star steps until all links lead straight to
    the smallest node. A step is a minimum by node, which combines before the
    shuffle, and a join that adaptive execution may split at hot nodes. Links
    never grow in number, and each round's are written to the shared folder, so
    lineage stays short. most_links bounds their number, if it is known.
    """
    links = _util.cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), most_links)
    while True:
        # done: no node has two centres, and no centre has one
        places = links.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionAll(links.select(F.col("v"), F.lit(0)))
        n, bad = places.groupBy("x").agg(F.sum("up").alias("ups"), F.count_if(F.col("up") == 0).alias("downs")).agg(F.sum("ups"), F.count_if((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("downs") > 0)))).first()
        if not bad:
            break
        both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        centre = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(centre, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(centre.select("u", F.col("m").alias("v")))
        old, links = links, _util.cut(small.where("u <> v").distinct(), n)
        _util.drop_cut(old)
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def joined(comp: DataFrame, links: DataFrame, most_links: int | None = None) -> DataFrame:
    """comp: node, component; links: a, b between components. The components after the links; components without nodes of their own stand for themselves."""
    new = components(links, most_links).select(F.col("node").alias("component"), F.col("component").alias("__to"))
    moved = comp.join(new, "component", "left").select("node", F.coalesce("__to", "component").alias("component"))
    alone = new.join(comp.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("__to").alias("component"))
    return moved.unionAll(alone)
