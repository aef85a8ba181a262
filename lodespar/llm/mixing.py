"""Mixing sources to target weights, by DataFrame and SQL functions only.

The tree has domains, below them languages, below them sources. A budget of
tokens goes down by the weights of siblings. No node gets more than its
capacity (its tokens times ``max_epochs``); what a node can't take goes to its
siblings by their weights, and only what all siblings can't take is missing
above, so shortages are settled among siblings before ancestors. All
arithmetic is in whole tokens; a share is rounded down, so each set of siblings
may leave less than one token per sibling.

A leaf's stream is one seeded permutation of its documents after another
(epochs). It yields the longest prefix that fits its budget: all documents once
for each full epoch, and of the epoch after those the documents whose tokens,
added up in that order, stay within the rest. The order is that of
md5(seed:epoch:id) with ties by tokens. The sums come from 4096 ranges of
that hash, and only the one range in which a leaf's prefix ends is ordered row
by row, so that a leaf with any share of the rows is spread over all tasks.

Edge cases: null domain, language or source is a sibling of its own, named
"(none)". Null ids hash as "". A null or empty text has no token and is taken
with the prefix it lies in; a text of any length counts whole. Rows that repeat
are taken as often as they stand. Ties of rows in a leaf's order, of the same
hash and tokens, are cut in any order. A leaf without tokens gets nothing. Other
columns may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _util

#: Weights by domain, language and source; others have weight 1.
WEIGHTS: tuple[dict[str, int], ...] = ({"group0": 4, "group1": 3, "group2": 2}, {"en": 5, "de": 2, "fr": 2}, {})
#: Share of the available tokens that is asked for, in hundredths.
BUDGET_PCT = 80
MAX_EPOCHS = 2
SEED = 42
#: Domain of a document: there is no such column, so sources are dealt to four domains by their last character.
DOMAIN = "concat('group', cast(ascii(right(source, 1)) % 4 as string))"
#: Most leaves, and bytes of their names, whose plan is sent to every executor; a larger plan joins by a shuffle, with the same result.
BROADCAST_LEAVES, BROADCAST_BYTES = 50_000, 8 << 20
LEVELS = ("domain", "lang", "source")


def n_tokens(text: Column) -> Column:
    """Words of a text, as its number of tokens."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _weight(name: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for k, v in sorted(weights.items()):
        out = F.when(F.col(name) == k, v).otherwise(out)
    return out.cast("bigint")


def share(children: DataFrame, parent: list[str], name: str, weights: dict[str, int]) -> DataFrame:
    """children: parent columns, name, cap, budget (of the parent). Returns them with the child's own share as budget."""
    by = [F.col(c) for c in parent] or [F.lit(0)]
    ordered = Window.partitionBy(*by).orderBy(F.col("cap") / F.col("w"), F.col(name))
    before = F.coalesce(F.sum("cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    big = lambda c: c.cast("decimal(38,0)")
    x = children.withColumn("w", _weight(name, weights)).withColumn("before", before).withColumn("left", left)
    x = x.withColumn("full", big(F.col("cap").cast("decimal(19,0)") * F.col("left").cast("decimal(18,0)")) <= big(F.col("w").cast("decimal(18,0)") * (F.col("budget") - F.col("before")).cast("decimal(19,0)")))
    whole = Window.partitionBy(*by)
    x = x.withColumn("rest", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0))).withColumn("open", F.sum(F.when(~F.col("full"), F.col("w"))).over(whole))
    return x.withColumn("budget", F.expr("case when full then cap else (w * rest) div open end")).drop("w", "before", "left", "full", "rest", "open")


def plan(rows: DataFrame, weights=WEIGHTS, budget_pct: int = BUDGET_PCT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """rows: domain, lang, source, n_tokens. Returns per leaf: total, budget, full (epochs), rest (tokens of the epoch after)."""
    leaves = _util.cut(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("total")))
    caps = leaves.withColumn("cap", F.col("total") * max_epochs)
    langs = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.sum("total").alias("total"))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("total").alias("total"))
    top = share(domains.withColumn("budget", F.expr(f"(sum(total) over (partition by 0) * {int(budget_pct)}) div 100")), [], "domain", weights[0])
    mid = share(langs.drop("total").join(top.select("domain", "budget"), "domain"), ["domain"], "lang", weights[1])
    low = share(caps.join(mid.select("domain", "lang", "budget"), ["domain", "lang"]), ["domain", "lang"], "source", weights[2])
    return low.where("total > 0").select(*LEVELS, "total", "budget", F.expr("budget div total").alias("full"), F.expr("budget % total").alias("rest"))


def _described(docs: DataFrame, id_col: str, text_col: str, domain: str) -> DataFrame:
    """The columns of docs as __c0, __c1, ..., so that no name of theirs can meet one used here, and what the plan needs."""
    none = F.lit("(none)")
    own = [F.col(f"`{n}`").alias(f"__c{i}") for i, n in enumerate(docs.columns)]
    return docs.select(
        *own, F.coalesce(F.expr(domain), none).alias("__domain"), F.coalesce(F.col("lang"), none).alias("__lang"), F.coalesce(F.col("source"), none).alias("__source"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("__id"), n_tokens(F.col(f"`{text_col}`")).alias("__tokens")
    )


def _planned(rows: DataFrame, compact: DataFrame, seed: int, weights, budget_pct: int, max_epochs: int) -> DataFrame:
    """rows (with the __ columns of _described): those that are taken, with their number of copies as __copies."""
    named = compact.select(F.col("__domain").alias("domain"), F.col("__lang").alias("lang"), F.col("__source").alias("source"), F.col("__tokens").alias("n_tokens"), "__id")
    leaves = _util.cut(plan(named, weights, budget_pct, max_epochs))
    many, wide = leaves.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.concat(*LEVELS))), F.lit(0))).first()
    small = many <= BROADCAST_LEAVES and wide <= BROADCAST_BYTES
    leaf = lambda x: F.broadcast(x) if small else x
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("full").cast("string"), F.lit(":"), F.col("__id")).cast("binary"))
    ranges = named.join(leaf(leaves), list(LEVELS)).withColumn("range", F.substring(order, 1, 3)).groupBy(*LEVELS, "range", "rest").agg(F.sum("n_tokens").alias("n"))
    upto = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ends = ranges.withColumn("upto", F.sum("n").over(upto)).where("upto > rest").groupBy(*LEVELS).agg(F.min(F.struct("range", "upto", "n")).alias("m")).select(*LEVELS, F.col("m.range").alias("last"), (F.col("m.upto") - F.col("m.n")).alias("before"))
    ends = leaves.join(ends, list(LEVELS)).select(F.col("domain").alias("__domain"), F.col("lang").alias("__lang"), F.col("source").alias("__source"), "full", "rest", "last", "before")
    ends = _util.cut(ends)
    x = rows.join(leaf(ends), ["__domain", "__lang", "__source"]).withColumn("__order", order).withColumn("__range", F.substring("__order", 1, 3))
    sure = x.where("__range <> last").withColumn("__copies", F.col("full") + (F.col("__range") < F.col("last")).cast("bigint"))
    inside = Window.partitionBy("__domain", "__lang", "__source").orderBy("__order", "__tokens").rowsBetween(Window.unboundedPreceding, 0)
    last = x.where("__range = last").withColumn("__upto", F.col("before") + F.sum("__tokens").over(inside)).withColumn("__copies", F.col("full") + (F.col("__upto") <= F.col("rest")).cast("bigint")).drop("__upto")
    return sure.unionByName(last).where("__copies > 0").drop("full", "rest", "last", "before", "__order", "__range")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain: str = DOMAIN, seed: int = SEED, weights=WEIGHTS, budget_pct: int = BUDGET_PCT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per document taken and epoch: the id, domain, lang, source, n_tokens, epoch (from 0)."""
    rows = _util.cut(_described(docs, id_col, text_col, domain).select(F.col(f"__c{docs.columns.index(id_col)}").alias("doc_id"), "__domain", "__lang", "__source", "__id", "__tokens"))
    x = _planned(rows, rows, seed, weights, budget_pct, max_epochs)
    x = x.select("doc_id", F.col("__domain").alias("domain"), F.col("__lang").alias("lang"), F.col("__source").alias("source"), F.col("__tokens").alias("n_tokens"), "__copies")
    return x.select("doc_id", "domain", "lang", "source", "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__copies") - 1)).alias("epoch"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain: str = DOMAIN, seed: int = SEED, weights=WEIGHTS, budget_pct: int = BUDGET_PCT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The rows of docs that are taken, once per epoch, with docs' own columns. docs must have lang and source."""
    names = docs.columns
    compact = _util.cut(_described(docs, id_col, text_col, domain).select("__domain", "__lang", "__source", "__id", "__tokens"))
    x = _planned(_described(docs, id_col, text_col, domain), compact, seed, weights, budget_pct, max_epochs)
    copies = x.select(*[f"__c{i}" for i in range(len(names))], F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies"))).alias("__epoch"))
    return copies.drop("__epoch").toDF(*names)


def _cases(weights: dict[str, int], name: str) -> str:
    return "case " + name + "".join(f" when '{k}' then {v}" for k, v in sorted(weights.items())) + " else 1 end" if weights else "1"


def _level(name: str, parent: str, source: str, weights: dict[str, int]) -> str:
    return f"""{name}_a as (select *, {_cases(weights, name)} w from {source}),
{name}_b as (select *, coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0)::bigint bef, sum(w) over (o rows between current row and unbounded following)::bigint lft from {name}_a window o as (partition by {parent} order by cap / w, {name})),
{name}_c as (select *, cap::hugeint * lft <= w::hugeint * (budget - bef) sat from {name}_b),
{name}_d as (select *, (budget - coalesce(sum(cap) filter (sat) over (partition by {parent}), 0))::bigint rst, (sum(w) filter (not sat) over (partition by {parent}))::bigint opn from {name}_c),
{name}_e as (select * exclude (budget, w, bef, lft, sat, rst, opn), case when sat then cap else (w * rst) // opn end budget from {name}_d)"""


SQL = rf"""
with d as (select doc_id, concat('group', (ascii(right(source, 1)) % 4)::varchar) as domain, lang, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::bigint n_tokens from documents),
leaves as (select domain, lang, source, sum(n_tokens)::bigint total, sum(n_tokens)::bigint * {MAX_EPOCHS} cap from d group by all),
langs as (select domain, lang, sum(cap)::bigint cap, sum(total)::bigint total from leaves group by all),
domains as (select *, ((sum(total) over ())::bigint * {BUDGET_PCT}) // 100 budget from (select domain, sum(cap)::bigint cap, sum(total)::bigint total from langs group by all)),
{_level("domain", "1", "domains", WEIGHTS[0])},
l0 as (select langs.domain, lang, langs.cap, budget from langs join domain_e using (domain)),
{_level("lang", "domain", "l0", WEIGHTS[1])},
s0 as (select leaves.domain, leaves.lang, source, leaves.cap, total, budget from leaves join lang_e on leaves.domain = lang_e.domain and leaves.lang = lang_e.lang),
{_level("source", "domain, lang", "s0", WEIGHTS[2])},
p as (select domain, lang, source, budget // total as fulls, budget % total rest from source_e where total > 0),
x as (select d.*, fulls, rest, sum(n_tokens) over (partition by d.domain, d.lang, d.source order by md5('{SEED}:' || fulls || ':' || doc_id), n_tokens rows unbounded preceding) upto
  from d join p on d.domain = p.domain and d.lang = p.lang and d.source = p.source),
c as (select *, fulls + (upto <= rest)::bigint copies from x)
select doc_id, domain, lang, source, n_tokens, unnest(range(copies)) epoch from c where copies > 0
"""
