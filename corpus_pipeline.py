"""A training corpus from raw documents: grade, rules by host, near-duplicates, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each one's rows to the shared folder and reads them back as the next one's docs.

All stages take rows with nulls in any column, empty and very long texts, ties
and repeated rows, extra columns of any names, and empty tables; what each does
with them stands with it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodespar.llm import _util, bagminhash, host_rules, mixing, ordinal_quality, sentencepiece_unigram
from lodespar.llm.queries import tokenizer_path

#: Least probability of a grade above the lowest with which a document stays.
LEAST = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is likely above the lowest; the model learns from the labelled documents among docs.

    A null or empty text is graded by its length alone. Repeated rows are
    graded alike and stay as often as they stand. Labels without an id or a
    grade don't count; without labels of two grades every document stays or
    goes by the one grade there is. A probability of just LEAST keeps a row.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = ordinal_quality.fit(docs.select("doc_id", "text"), ordinal_quality.grade_labels(labels))
    return ordinal_quality.select_documents(docs, model, grade=1, least=LEAST)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and stand on no rejected host.

    A null or empty text fails. A document without a source has no host that
    could reject it. Repeated rows count as often as they stand.
    """
    return host_rules.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id, null ids last, and of equal ones the first.

    Texts without a word are no duplicates of anything and stay.
    """
    return bagminhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target shares, once per epoch.

    Null languages and sources are siblings of their own. A text without a word
    takes no budget and goes with the prefix it lies in.
    """
    return mixing.mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_pieces, n_bytes and the ids of its pieces; none for a null or empty text. Repeated rows are encoded each."""
    return sentencepiece_unigram.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("host_rules", rules), ("near_duplicates", near_duplicates), ("mixing", mixture), ("sentencepiece", pieces)]

#: The classifier, the signatures and the pieces are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{_util.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}/{k}-{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
