"""Quality rules with host verdicts.

Every text is measured by fixed rules. Rule failures are summed by host, each
host's failure rate is shrunk towards the corpus by a beta prior fitted to the
hosts' rates (method of moments), and hosts whose shrunk rate is above
``max_rate`` reject all their documents.

Edge cases: a null or empty text has no word and fails the base rules. A text
of any length is read whole. A null host has no verdict. A rate of just the
greatest one allowed rejects nothing. Repeated rows count as often as they
stand, and rows with one id are judged each by its own text. An empty table
gives an empty result. Column names of the input don't matter, for the columns
that are needed are taken out first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _util
from ._words import _IS_SPACE, Words, windows

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

COUNTS = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint>"
#: Most rejected hosts, and bytes of their names, that are sent to every executor; more join by a shuffle, with the same result.
BROADCAST_HOSTS, BROADCAST_BYTES = 50_000, 8 << 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def _again(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item whether its key stands at least twice in its row, and whether it stands there earlier."""
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    later, twice = np.zeros(len(k), bool), np.zeros(len(k), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def count_rules(w: Words) -> dict[str, np.ndarray]:
    rows = len(w.offs) - 1
    raw, n = w.raw, len(w.raw)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[w.offs[1:]] - total[w.offs[:-1]]

    chars = per_row(~_IS_SPACE[raw] & ((raw & 0xC0) != 0x80))
    symbols = per_row(_SYMBOL[raw])
    cut = raw == 10
    starts = np.union1d(w.offs[:-1][np.diff(w.offs) > 0], np.flatnonzero(cut) + 1)
    starts = starts[starts < n]
    ends = np.append(starts[1:], n)
    ends = ends - (cut[ends - 1] if n else 0)
    filled = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends = starts[filled], ends[filled]
    row = np.searchsorted(w.offs, starts, "right") - 1
    _, later = _again(w.span_hash(starts, ends), row)
    dup_lines = np.bincount(row[later], minlength=rows)
    x, at = windows(w.hashes(), w.doc, 3)
    twice, _ = _again(x, w.doc[at])
    hit = np.zeros(len(w.start), bool)
    for j in range(3):
        hit[at[twice] + j] = True
    return {"n_words": w.counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": np.bincount(w.doc[hit], minlength=rows)}


def _count_texts(text: pa.Array) -> pa.Array:
    batch = pa.record_batch([text], names=["t"])
    parts = []
    for piece in _util.steps(iter([batch]), "t"):
        counts = count_rules(Words.of(piece.column(0)))
        parts.append(pa.StructArray.from_arrays([pa.array(v.astype(np.int64)) for v in counts.values()], list(counts)))
    return pa.concat_arrays(parts) if parts else pa.StructArray.from_arrays([pa.array([], pa.int64())] * 5, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def rule_counts(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text."""
    return F.arrow_udf(_count_texts, COUNTS).asNondeterministic()(text)


def base_failed(c: Column, min_words: int = 50, max_repeat_pct: int = 50) -> Column:
    return (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeat_pct * c["n_words"])


def rejected_hosts(checked: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """checked: host, failed. Returns the rejected hosts: host, n_docs, n_failed, rate (shrunk).

    The prior is Beta(a, b) with mean p = failures / documents and the variance
    of the hosts' rates around p, weighted by documents, less what drawing the
    documents adds. a + b lies between 1 and 1,000,000.
    """
    hosts = checked.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    total = hosts.agg(
        F.sum("n_docs").cast("double").alias("n"), F.sum("n_failed").cast("double").alias("f"), F.count(F.lit(1)).cast("double").alias("h"),
        F.sum(F.col("n_failed").cast("double") * F.col("n_failed") / F.col("n_docs")).alias("ff"),
    )
    p, n, h = F.col("f") / F.col("n"), F.col("n"), F.col("h")
    spread = F.greatest((F.col("ff") / n - p * p) - p * (1 - p) * h / n, F.lit(1e-12))
    prior = total.select(p.alias("p"), F.least(F.greatest(p * (1 - p) / spread - 1, F.lit(1.0)), F.lit(1e6)).alias("strength"))
    rate = (F.col("n_failed") + F.col("p") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    # one row of prior meets every host: the other side of this join is one row by construction
    return hosts.join(F.broadcast(prior)).withColumn("rate", rate).where(F.col("rate") > max_rate).select("host", "n_docs", "n_failed", "rate")


def with_host_verdict(df: DataFrame, host: str, rejected: DataFrame, flag: str) -> DataFrame:
    """Adds the boolean column flag: whether the row's host is among the rejected ones."""
    bad = _util.cut(rejected.select(F.col("host").alias("__bad_host")))
    many, wide = bad.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("__bad_host")), F.lit(0))).first()
    if many <= BROADCAST_HOSTS and wide <= BROADCAST_BYTES:
        bad = F.broadcast(bad)
    return df.join(bad, df[host] == F.col("__bad_host"), "left").withColumn(flag, F.col("__bad_host").isNotNull()).drop("__bad_host")


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """Per row: the id, the counts, base_failed and kept."""
    _util.ship(df.sparkSession)
    counted = df.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), rule_counts(F.col(text_col)).alias("c"))
    counted = _util.cut(counted.select("doc_id", "host", "c.*", base_failed(F.col("c")).alias("base_failed")))
    bad = rejected_hosts(counted.select("host", F.col("base_failed").alias("failed")), max_rate)
    out = with_host_verdict(counted, "host", bad, "host_rejected")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected")


def keep_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The rows of docs that pass the base rules and stand on no rejected host, with docs' own columns.

    The texts are measured twice and never shuffled: once for the hosts, once for the verdict.
    """
    _util.ship(docs.sparkSession)
    first = docs.select(F.col(host_col).alias("host"), rule_counts(F.col(text_col)).alias("c"))
    bad = rejected_hosts(first.select("host", base_failed(F.col("c")).alias("failed")), max_rate)
    names = docs.columns
    inner = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    at = {n: f"__c{i}" for i, n in enumerate(names)}
    kept = inner.withColumn("__rules", rule_counts(F.col(at[text_col]))).where(~base_failed(F.col("__rules"))).drop("__rules")
    kept = with_host_verdict(kept, at[host_col], bad, "__rejected").where(~F.col("__rejected")).drop("__rejected")
    return kept.toDF(*names)


#: The same for DuckDB over the view documents.
SQL = r"""
with d as (select doc_id, source, coalesce(text, '') t from documents),
words as (select doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w from d),
lines as (select doc_id, count(*) - count(distinct l) dup from (select doc_id, unnest(string_split(t, chr(10))) l from d) where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id),
tri as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from (select doc_id, w, unnest(range(1, len(w) - 1)) i from words)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) n from tri) where n > 1),
rep as (select doc_id, count(distinct i + j) n from twice, (select unnest(range(3)) j) group by doc_id),
c as (select words.doc_id, source, len(w)::bigint n_words, coalesce(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')), 0)::bigint word_chars,
  coalesce(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')), 0)::bigint n_symbols, coalesce(dup, 0)::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words
  from words left join lines on lines.doc_id = words.doc_id left join rep on rep.doc_id = words.doc_id),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from c),
h as (select source host, count(*) n, sum(base_failed::int)::double f from b where source is not null group by source),
p as (select sum(f) / sum(n) p, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n)) v, count(*)::double h, sum(n)::double n from h),
s as (select p, least(greatest(p * (1 - p) / greatest(v - p * (1 - p) * h / n, 1e-12) - 1, 1.0), 1e6) k from p),
bad as (select host from h, s where (f + p * k) / (n + k) > 0.5)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and bad.host is null kept, bad.host is not null host_rejected
from b left join bad on bad.host = b.source
"""
