"""Each stage of the pipeline against a plain version of it, on the stage's own input."""

import re
from collections import Counter

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodespar.llm import mixing, ordinal_quality, sentencepiece_unigram

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input of each stage and the output of the last."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, D).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1]) and stages[-1].columns == ["doc_id", "n_pieces", "n_bytes", "ids"]


def test_quality(spark, stages):
    docs = stages[0]
    model = ordinal_quality.fit(docs.select("doc_id", "text"), ordinal_quality.grade_labels(spark.read.parquet(f"{D}/labels.parquet")))
    rows = docs.collect()
    keep = [r.doc_id for r in rows if model.results(pa.array([r.text]), 1)[1][0] >= 0.5]
    assert ids(stages[1]) == sorted(keep) and len(keep) < len(rows)


def _fails(text: str) -> bool:
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_rules(stages):
    rows = stages[1].collect()
    n, f = Counter(r.source for r in rows), Counter(r.source for r in rows if _fails(r.text))
    p = sum(f.values()) / len(rows)
    spread = max(sum(f[h] ** 2 / n[h] for h in n) / len(rows) - p * p - p * (1 - p) * len(n) / len(rows), 1e-12)
    k = min(max(p * (1 - p) / spread - 1, 1), 1e6)
    bad = {h for h in n if (f[h] + p * k) / (n[h] + k) > 0.5}
    assert ids(stages[2]) == sorted(r.doc_id for r in rows if r.source not in bad and not _fails(r.text))


def test_near_duplicates(stages):
    rows = sorted(stages[2].collect(), key=lambda r: r.doc_id)
    bags = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", r.text)
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)]))
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = (bags[i] & bags[j]).total()
            if both >= 0.8 * (bags[i].total() + bags[j].total() - both):
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    assert ids(stages[3]) == [r.doc_id for i, r in enumerate(rows) if find(i) == i]


def test_mixing(stages):
    documents = stages[3].toArrow()  # noqa: F841
    want = duckdb.sql(mixing.SQL).fetchall()
    assert ids(stages[4]) == sorted(r[0] for r in want)


def test_pieces(stages):
    m = sentencepiece_unigram.load(public_tokenizers.path("piece_bpe_32k.model"))
    texts = Counter((r.doc_id, r.text) for r in stages[4].collect())
    got = stages[5].collect()
    assert Counter((r.doc_id, m.decode(pa.array(r.ids).to_numpy())) for r in got) == texts and all(r.n_pieces == len(r.ids) for r in got)


def test_run(spark, stages):
    out = corpus_pipeline.run(spark, D)
    assert ids(out) == ids(stages[5]) and out.where(F.size("ids") != F.col("n_pieces")).count() == 0
