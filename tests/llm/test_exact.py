"""Operators against libraries, brute force, SQL, and held-out labels."""

import random
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodespar.llm import bagminhash, bitplane, ordinal_quality, queries, rp_forest, sentencepiece_unigram, toxicity_kn

ODD = ["", " ", "  ", "a  b   c", "x\n y\n\n z \n", "foo \nbar", "tail ", "tail  ", "tail\n ", "\t \t a", "a  b", "a\x1c b \x1c", "<|endoftext|> hi", "日本語 テスト", "😀 x", "it's we'll", "\x00\x01", "a" * 300 + " b", "  lead", "x    y"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(name, spark, sf_dir, same):
    same(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name])


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rng = random.Random(1)
    letters = [" ", "\n", "a", "B", "1", ".", "'s", "\t", "é", " ", "\x1c", "\r", "  "]
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    got = bitplane.Encoder(path, limit=50).many(pa.array(texts))
    assert [g.tolist() for g in got] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_merges_a_part_once():
    """Words that differ in their marks share the library's merges, within and across calls; ids are the library's."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    words = ["merger", "Übermäßig", "naïveté", "it's", "we'llness", "x86", "<|endoftext|>", "ß"]
    texts = [" ".join(f"{a}{w}{m}" for w in words) for a in ("", "(", "the.\n") for m in ("", ",", ".", "&&&", "'", "'s", "\n\nEnd", "12'd")]
    e, merged = bitplane.Encoder(path), []
    solve, e.parts.solve = e.parts.solve, lambda parts: merged.extend(parts) or solve(parts)
    got = [ids.tolist() for text in texts for ids in e.many(pa.array([text]))]
    assert got == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert len(merged) == len(set(merged)) < len({w for text in texts for w in text.split(" ")})
    e = bitplane.Encoder(path, limit=5)
    for _ in range(3):
        assert [ids.tolist() for text in texts for ids in e.many(pa.array([text]))] == got


def test_cutting_rule_equals_library():
    """Parts and shown bytes of known words are those of the library's own cutter."""
    from tokenizers.pre_tokenizers import ByteLevel

    cut, rng = ByteLevel(add_prefix_space=False).pre_tokenize_str, random.Random(2)
    letters = [chr(c) for c in (*range(33, 127), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7)]
    letters += ["\n"] * 12 + ["'s", "'ll", "'re", "'S"] * 3 + list("abcXYZ019é") * 4
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(20_000)]
    known = [" " + w for w in words if bitplane._KNOWN(" " + w)]
    assert len(known) == sum(w.strip() == w for w in words) > 10_000
    for i in range(0, len(known), 3):
        text = "".join(known[i : i + 3])
        assert ["".join(chr(bitplane._SHOWN[b]) for b in p.encode()) for p in bitplane._PARTS(text)] == [p for p, _ in cut(text)]
    assert not any(bitplane._KNOWN(w) for w in ("", " ", "a", " a\n", " \na", "  a", " a ", " ×", " 日", " a\tb", " \0"))


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _fields(b: bytes):
    i = 0

    def number():
        nonlocal i
        shift = value = 0
        while True:
            c = b[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while i < len(b):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, kind, number()
        else:
            n = number() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, kind, b[i : i + n]
            i += n


def _join(fields) -> bytes:
    return b"".join(_varint(f << 3 | k) + (_varint(v) if k == 0 else _varint(len(v)) + v if k == 2 else v) for f, k, v in fields)


def test_pieces_equal_library():
    """The library loads the same pieces and scores as a Unigram model; stretches are compared alone, for in long texts rounding decides its ties."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece_unigram.load(path)
    out, i = [], 0
    for f, k, v in _fields(open(path, "rb").read()):
        if f == 1:
            v, i = _join((a, b, struct.pack("<f", float(m.scores[i])) if a == 2 else c) for a, b, c in _fields(v)), i + 1
        elif f == 2:
            v = _join((a, b, 1 if a == 3 else c) for a, b, c in _fields(v))
        out.append((f, k, v))
    lib = sentencepiece.SentencePieceProcessor(model_proto=_join(out))
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghinorstuéß日😀.,$#1\n") for _ in range(rng.randint(1, 14))) for _ in range(800)] + ["ab" * 80, "the", "thebest"]
    score = lambda ids: float(m.scores[ids].sum())
    for w, got in zip(words, sentencepiece_unigram.Encoder(m).many(pa.array(words))):
        want = lib.encode(w)
        assert got.tolist() == want or score(got.tolist()) == pytest.approx(score(want), abs=1e-4)
    enc = sentencepiece_unigram.Encoder(m)
    assert [m.decode(x) for x in enc.many(pa.array(ODD))] == ODD
    assert m.solve_one("▁hello😀".encode()) == m.solve(["▁hello😀".encode()])[0]


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(30):
        a = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
        ca = rng.integers(1, 20, 300)
        cb = np.maximum(ca + rng.integers(-6, 7, 300), 0)
        keep = cb > 0
        row = np.concatenate((np.zeros(300, int), np.ones(keep.sum(), int)))
        s = bagminhash.signatures(row, np.concatenate((a, a[keep])), np.concatenate((ca, cb[keep])), 2, 1000)
        errors.append((s[0] == s[1]).mean() - np.minimum(ca, cb).sum() / np.maximum(ca, cb).sum())
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


def test_embedding_recall(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 32))
    x = np.concatenate([b + rng.standard_normal((n, 32)) * 0.1 for b, n in zip(base, [200] + [5] * 39)])
    label = np.arange(len(x)) % 2
    df = spark.createDataFrame([(i, v.tolist(), int(label[i])) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((u @ u.T >= 0.98) & (label[:, None] == label)).sum(1) - 1
    got = np.array([r.n_links for r in rp_forest.near_duplicates(df).orderBy("vec_id").collect()])
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum() > 0


def _labelled(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    return docs, labels, held


def test_toxicity_on_held_out_labels(spark):
    docs, labels, held = _labelled(spark)
    s = toxicity_kn.fit(docs, labels.where(~held))
    rows = toxicity_kn.score(docs, s).join(labels, "doc_id").where(held).select("score", "toxic").collect()
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in rows if a.toxic for b in rows if not b.toxic]
    assert np.mean(pairs) > 0.8


def test_quality_on_held_out_labels(spark):
    docs, labels, held = _labelled(spark)
    m = ordinal_quality.fit(docs, ordinal_quality.grade_labels(labels.where(~held)))
    q = ordinal_quality.results(m, F.col("text"), spark, 1)
    rows = docs.join(labels, "doc_id").where(held).withColumn("q", q).select("q.tail", "quality").collect()
    assert np.mean([(r.tail >= 0.5) == (r.quality == 1) for r in rows]) > 0.95
