"""Aggregation, grouping sets and marks of distinct rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aggregate(df: DataFrame, keys: Sequence[str | Column], aggs: Sequence[str | Column]) -> DataFrame:
    """SQL or column aggregates, e.g. "sum(a) filter (where b > 0) as s". Without keys there is one row, for empty input too; without aggregates the distinct keys."""
    exprs = [F.expr(a) if isinstance(a, str) else a for a in aggs]
    if not exprs:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*exprs) if keys else df.agg(*exprs)


def streaming_aggregate(df: DataFrame, keys: Sequence[str], aggs: Sequence[str | Column]) -> DataFrame:
    """The same over rows that come grouped by key; where they come in partitions of their keys, Spark adds no exchange."""
    return aggregate(df, keys, aggs)


def expand(df: DataFrame, projections: Sequence[Sequence[str | Column]], names: Sequence[str]) -> DataFrame:
    """Each row once per projection; projections are expressions in the order of names."""
    rows = [F.struct(*[(F.expr(e) if isinstance(e, str) else e).alias(n) for e, n in zip(p, names)]) for p in projections]
    return df.select(F.inline(F.array(*rows)))


def group_id(df: DataFrame, sets: Sequence[Sequence[str]], inputs: Sequence[str] = (), name: str = "group_id") -> DataFrame:
    """Each row once per grouping set (repeated sets count), with absent keys null and the ordinal of the set."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    kinds = dict(df.dtypes)
    rows = [F.struct(*[(F.col(k) if k in s else F.lit(None).cast(kinds[k])).alias(k) for k in keys], *[F.col(c).alias(f"{c}" if c not in keys else f"{c}_input") for c in inputs], F.lit(i).cast("bigint").alias(name)) for i, s in enumerate(sets)]
    return df.select(F.inline(F.array(*rows)))


def mark_distinct(df: DataFrame, keys: Sequence[str], name: str = "is_distinct", order: Sequence[str | Column] = ()) -> DataFrame:
    """Marks one row of each distinct key (nulls are equal): the first by order."""
    w = Window.partitionBy(*keys).orderBy(*(order or [F.lit(0)]))
    return df.withColumn(name, F.row_number().over(w) == 1)


class partial_state:
    """Aggregates in two steps: partial() gives a state per group, merge() joins states, extract() gives the value.

    States are structs: count (n), sum (n, total), avg (n, total); moments (n,
    mean, and the sums of the second to fourth powers around the mean) and
    pairs (n, both means, both sums of squares and that of products around
    them), which merge by the pairwise rules; a sketch; or the value itself.
    Kinds of two inputs take a struct of x and y (or of value and key). Of
    equal keys max_by takes the largest value and min_by the smallest; a key of
    several fields decides otherwise.
    """

    #: What merges as it is made: kind -> its aggregate.
    SAME = {"min": F.min, "max": F.max, "bool_and": F.bool_and, "bool_or": F.bool_or, "bitwise_and_agg": F.bit_and, "bitwise_or_agg": F.bit_or, "bitwise_xor_agg": F.bit_xor, "arbitrary": lambda x: F.any_value(x, True)}
    MOMENTS = ("var_samp", "var_pop", "stddev_samp", "stddev_pop", "skewness", "kurtosis")
    PAIRS = ("covar_pop", "covar_samp", "corr", "regr_slope", "regr_intercept", "regr_r2", "regr_count", "regr_avgx", "regr_avgy", "regr_sxx", "regr_syy", "regr_sxy")
    KINDS = ("count", "count_if", "sum", "avg", "geometric_mean", "min_by", "max_by", "approx_distinct", "array_agg", "set_agg", "entropy", *SAME, *MOMENTS, *PAIRS)

    @staticmethod
    def partial(kind: str, x: Column) -> Column:
        P = partial_state
        if kind in P.SAME:
            return F.struct(P.SAME[kind](x).alias("v"))
        if kind in ("min_by", "max_by"):
            best = (F.min if kind == "min_by" else F.max)(F.when(x["y"].isNotNull(), F.struct(x["y"].alias("y"), x["x"].alias("x"))))
            return F.struct(best.alias("v"))
        if kind == "count_if":
            return F.struct(F.count_if(x).alias("n"))
        if kind in ("count", "sum", "avg"):
            return F.struct(F.count(x).alias("n"), F.sum(x.cast("double") if kind == "avg" else x).alias("total"))
        if kind == "geometric_mean":
            return P.partial("avg", F.log(x.cast("double")))
        if kind == "entropy":
            c = x.cast("double")
            return F.struct(F.sum(c).alias("n"), F.sum(F.when(c > 0, c * F.log2(c))).alias("total"))
        if kind == "approx_distinct":
            return F.struct(F.hll_sketch_agg(x).alias("v"))
        if kind in ("array_agg", "set_agg"):
            return F.struct((F.collect_list if kind == "array_agg" else F.collect_set)(x).alias("v"))
        if kind in P.PAIRS:
            both = x["x"].isNotNull() & x["y"].isNotNull()
            a, b = (F.when(both, x[c].cast("double")) for c in "xy")
            n = F.count(a)
            return F.struct(n.alias("n"), F.avg(a).alias("mx"), F.avg(b).alias("my"), (F.var_pop(a) * n).alias("xx"), (F.var_pop(b) * n).alias("yy"), (F.covar_pop(a, b) * n).alias("xy"))
        d = x.cast("double")
        n, v = F.count(d), F.var_pop(d)
        some = lambda c: F.when(v > 0, c).otherwise(0.0)
        return F.struct(n.alias("n"), F.avg(d).alias("mean"), (v * n).alias("m2"), some(F.skewness(d) * F.pow(v, F.lit(1.5)) * n).alias("m3"), some((F.kurtosis(d) + 3) * v * v * n).alias("m4"))

    @staticmethod
    def merge(kind: str, state: Column) -> Column:
        P = partial_state
        if kind in P.SAME:
            return F.struct(P.SAME[kind](state["v"]).alias("v"))
        if kind in ("min_by", "max_by"):
            return F.struct((F.min if kind == "min_by" else F.max)(state["v"]).alias("v"))
        if kind == "count_if":
            return F.struct(F.sum(state["n"]).alias("n"))
        if kind in ("count", "sum", "avg", "geometric_mean", "entropy"):
            return F.struct(F.sum(state["n"]).alias("n"), F.sum(state["total"]).alias("total"))
        if kind == "approx_distinct":
            return F.struct(F.hll_union_agg(state["v"]).alias("v"))
        if kind in ("array_agg", "set_agg"):
            flat = F.flatten(F.collect_list(state["v"]))
            return F.struct((flat if kind == "array_agg" else F.array_distinct(flat)).alias("v"))
        n = F.sum(state["n"])
        if kind in P.PAIRS:
            mx, my = (F.sum(state["n"] * state[m]) / F.when(n > 0, n) for m in ("mx", "my"))
            around = lambda s, a, b, ma, mb: F.sum(state[s] + state["n"] * state[a] * state[b]) - n * ma * mb
            return F.struct(n.alias("n"), mx.alias("mx"), my.alias("my"), around("xx", "mx", "mx", mx, mx).alias("xx"), around("yy", "my", "my", my, my).alias("yy"), around("xy", "mx", "my", mx, my).alias("xy"))
        mean = F.sum(state["n"] * state["mean"]) / F.when(n > 0, n)
        # powers around 0 of each state, added up, less those of the joint mean
        u, c = state["mean"], state["n"]
        p2, p3 = F.sum(state["m2"] + c * u * u), F.sum(state["m3"] + 3 * u * state["m2"] + c * u * u * u)
        p4 = F.sum(state["m4"] + 4 * u * state["m3"] + 6 * u * u * state["m2"] + c * u * u * u * u)
        m2 = p2 - n * mean * mean
        m3 = p3 - 3 * mean * p2 + 2 * n * mean * mean * mean
        m4 = p4 - 4 * mean * p3 + 6 * mean * mean * p2 - 3 * n * mean * mean * mean * mean
        return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"), m3.alias("m3"), m4.alias("m4"))

    @staticmethod
    def extract(kind: str, state: Column) -> Column:
        P = partial_state
        n = lambda least=1: F.when(state["n"] >= least, state["n"].cast("double"))
        if kind in P.SAME or kind in ("array_agg", "set_agg"):
            return state["v"]
        if kind in ("min_by", "max_by"):
            return state["v"]["x"]
        if kind == "approx_distinct":
            return F.hll_sketch_estimate(state["v"])
        if kind in ("count", "count_if", "regr_count"):
            return state["n"]
        if kind == "sum":
            return state["total"]
        if kind == "avg":
            return state["total"] / n()
        if kind == "geometric_mean":
            return F.exp(state["total"] / n())
        if kind == "entropy":
            total = F.when(state["n"] > 0, state["n"])
            return F.coalesce(F.log2(total) - state["total"] / total, F.lit(0.0))
        if kind in P.PAIRS:
            xx, yy, xy = (F.when(state["n"] > 0, state[k]) for k in ("xx", "yy", "xy"))
            spread = lambda c: F.when(c > 0, c)
            # as in regr_slope(y, x): the state's x is the first argument, y the second
            slope = xy / spread(yy)
            return {
                "covar_pop": lambda: xy / n(), "covar_samp": lambda: xy / (n(2) - 1), "corr": lambda: xy / F.sqrt(spread(xx) * spread(yy)), "regr_slope": lambda: slope, "regr_intercept": lambda: state["mx"] - slope * state["my"],
                "regr_r2": lambda: F.when((yy > 0) & (xx == 0), 1.0).otherwise(xy * xy / (spread(xx) * spread(yy))), "regr_avgx": lambda: state["my"], "regr_avgy": lambda: state["mx"], "regr_sxx": lambda: yy, "regr_syy": lambda: xx, "regr_sxy": lambda: xy,
            }[kind]()
        m2 = F.when(state["m2"] > 0, state["m2"])
        if kind == "skewness":
            return F.sqrt(n(3)) * state["m3"] / F.pow(m2, F.lit(1.5))
        if kind == "kurtosis":
            return n() * state["m4"] / (m2 * m2) - 3
        base = state["n"] - (1 if kind.endswith("samp") else 0)
        var = F.when(base > 0, state["m2"] / F.when(base > 0, base))
        return F.sqrt(F.greatest(var, F.lit(0.0))) if kind.startswith("stddev") else var
