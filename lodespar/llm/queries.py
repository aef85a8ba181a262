"""The queries of this subpackage for the driver, each over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util, bagminhash, bitplane, chat_template, host_rules, mixing, ordinal_quality, rp_forest, sentencepiece_unigram, site_style_tree, toxicity_kn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _held_out():
    """Null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_unigram.encode(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), digest=True)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_template.digests(chat_template.format_conversations(rows))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    known = _table(spark, sf_dir, "labels").where(~_held_out()).select("doc_id", "toxic")
    scorer = toxicity_kn.fit(docs, known)
    scored = toxicity_kn.score(docs, scorer)
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style_tree.extract(_table(spark, sf_dir, "pages"))


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bagminhash.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "component_id", "kept")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal_quality.fit(docs, ordinal_quality.grade_labels(_table(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", ordinal_quality.results(model, F.col("text"), spark, 1).alias("q"))
    return scored.select("doc_id", "q.expected_grade", F.col("q.tail").alias("tail_probability"), (F.col("q.tail") >= 0.5).alias("kept"))


def op8_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_bitplane(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{_util.shared_dir(spark).rstrip('/')}/planes-{uuid.uuid4().hex}"
    manifest = bitplane.write_shards(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), folder)
    return bitplane.read_documents(manifest, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_chat, op3_toxicity, op4_site_style_tree, op5_bagminhash, op6_quality, op7_mixing, op8_rp_forest, op9_host_rules, op10_bitplane)}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": chat_template.SQL, "op7_mixing": mixing.SQL, "op9_host_rules": host_rules.SQL}
