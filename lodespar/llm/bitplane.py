"""Token ids in files of shuffled planes.

Ids of 32 bits are cut into blocks of a fixed size. A block is transposed into
its four byte planes (or 32 bit planes), each plane is compressed by zstandard
on its own, and an index of all blocks stands at the end of the file, so any
block can be read alone.

File: MAGIC; the blocks' planes one after another; the documents' ids, null
flags and lengths, compressed; the index; 24 bytes with the index's place, its
length and MAGIC. The index is JSON: plane kind, block size, ids in all, and
per block the place, the number of ids and the compressed length of each plane.

write_shards() sorts a table by document id over range partitions of about
``SHARD_BYTES`` and writes one file per partition to the shared folder; a task writes to a name of its own
and renames at the end, so lost or repeated tasks leave no half file.

Edge cases: null and empty texts have only the end id. A text of any length is
encoded whole; one with a space between other white space goes to the library
as it is, all others by their words. Other columns of the input don't matter. Null document ids come
first. Rows with the same id stand next to each other, ordered by a hash of
their text. An empty table gives no file and an empty result.
"""

from __future__ import annotations

import io
import json
import os
import re
import uuid
import zlib
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _stretch, _util

MAGIC = b"LPLANES1"
BLOCK = 1 << 16
END_ID = 2
LEVEL = 3
#: Bytes of input for a file, about.
SHARD_BYTES = 128 << 20
#: Bytes of text that are encoded at once: the more, the fewer times a word is looked up.
STEP_BYTES = 4 << 20


def planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    out = ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T
    if kind == "byte":
        return [p.tobytes() for p in out]
    return [np.packbits((p >> k) & 1).tobytes() for p in out for k in range(8)]


def unplanes(parts: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    for i, p in enumerate(parts):
        raw = np.frombuffer(p, np.uint8)
        if kind == "byte":
            out[:, i] = raw
        else:
            out[:, i // 8] |= np.unpackbits(raw, count=n) << (i % 8)
    return out.view("<u4").ravel()


class Writer:
    """Streams ids of documents into a binary file object; memory holds one block and the documents' lengths."""

    def __init__(self, file, kind: str = "byte", block: int = BLOCK, level: int = LEVEL):
        self.file, self.kind, self.block = file, kind, block
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.at = file.write(MAGIC) and len(MAGIC)
        self.blocks: list[list] = []
        self.docs: list[int] = []
        self.nulls: list[bool] = []
        self.lengths: list[int] = []
        self.waiting: list[np.ndarray] = []
        self.held = self.total = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        end = len(ids) if last else len(ids) - len(ids) % self.block
        for i in range(0, end, self.block):
            part = ids[i : min(i + self.block, end)]
            packed = [self.pack(p) for p in planes(part, self.kind)]
            self.file.write(b"".join(packed))
            self.blocks.append([self.at, len(part), [len(p) for p in packed]])
            self.at += sum(map(len, packed))
            self.total += len(part)
        self.waiting = [ids[end:].copy()]
        self.held = len(ids) - end

    def close(self) -> None:
        self._flush(True)
        packed = [self.pack(np.asarray(x, t).tobytes()) for x, t in ((self.docs, "<i8"), (self.nulls, "u1"), (self.lengths, "<i8"))]
        self.file.write(b"".join(packed))
        index = zlib.compress(json.dumps({"kind": self.kind, "block": self.block, "ids": self.total, "docs": [self.at, [len(p) for p in packed]], "blocks": self.blocks}).encode())
        at = self.at + sum(map(len, packed))
        self.file.write(index + at.to_bytes(8, "little") + len(index).to_bytes(8, "little") + MAGIC)


class Reader:
    def __init__(self, file, size: int):
        self.file = file
        self.unpack = zstandard.ZstdDecompressor().decompress
        tail = self._read(size - 24, 24)
        if tail[16:] != MAGIC:
            raise ValueError("not a file of id planes")
        self.index = json.loads(zlib.decompress(self._read(int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:16], "little"))))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, i: int) -> np.ndarray:
        at, n, sizes = self.index["blocks"][i]
        raw = self._read(at, sum(sizes))
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        return unplanes([self.unpack(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], n, self.index["kind"])

    def documents(self):
        """Yields (doc id or None, ids) in file order, holding a block and a document at a time."""
        at, sizes = self.index["docs"]
        raw = self._read(at, sum(sizes))
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        docs, nulls, lengths = (np.frombuffer(self.unpack(raw[a:b]), t) for a, b, t in zip(cuts[:-1], cuts[1:], ("<i8", "u1", "<i8")))
        held, i = np.zeros(0, "<u4"), 0
        for d, null, n in zip(docs.tolist(), nulls.tolist(), lengths.tolist()):
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.block(i))
                have += len(parts[-1])
                i += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield (None if null else d), held[:n]
            held = held[n:]


#: White space, for RE2; and a space at which a text can't be cut for a byte-level vocabulary: white space before it, and white space or the end after it.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TIED = f"{_WS} (?:{_WS}|\\z)"
#: Letters of which all versions of Unicode and both engines of regular expressions think alike.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Words behind a space each, of these letters, ASCII digits and marks, and line ends inside.
_KNOWN = re.compile(f"(?: [!-~{_LETTERS}]++(?:\\n++[!-~{_LETTERS}]++)*+)++").fullmatch
#: The rule by which the library cuts a text before it merges, for known words.
_PARTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+").findall
#: The rule in the vocabulary's file that _PARTS stands for.
_RULE = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: Characters that stand for the 256 bytes in a byte-level vocabulary.
_SHOWN = np.arange(256, dtype="<u4")
_SHOWN[[*range(33), *range(127, 161), 173]] = np.arange(256, 324)


class Encoder:
    """Ids of whole texts under a byte-level vocabulary of the tokenizers library.

    Its rules never let a token pass a single space, so a text is cut before
    spaces and each distinct word is encoded once; a text with a space between
    other white space goes to the library whole. Words of western letters,
    digits and ASCII marks are cut further by the library's own rule, and its
    model gets each distinct part ("word" of "word," and "word.") once. Both are
    kept from task to task within _stretch's bounds.
    """

    def __init__(self, path: str, limit: int = _stretch.LIMIT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        rules = json.loads(self.tokenizer.to_str())
        cut = rules["pre_tokenizer"] or {}
        #: Whether the library's rule of cutting is the one known here.
        self.cuts = rules["normalizer"] is None and {k: cut.get(k) for k in _RULE} == _RULE and all(t["special"] for t in rules["added_tokens"])
        self.stretches = _stretch.Stretches(self._solve, self._whole, _TIED, True, limit)
        self.parts = _stretch.Stretches(self._merge, self._whole, _TIED, False, limit)

    def _solve(self, words: list[str]) -> list[bytes]:
        texts = [w[1:] if w[:1] == " " else " " + w for w in words]  # the first stretch of a text comes behind a space and has none
        out: list[bytes] = []
        for i in range(0, len(texts), 5000):
            part = texts[i : i + 5000]
            text = "".join(part)
            alike = self.cuts and text.count(" ") == len(part) and _KNOWN(text)
            out += self._by_parts(text, len(part)) if alike else self._sorts(part)
        return out

    def _sorts(self, texts: list[str]) -> list[bytes]:
        """Plain words stand behind a space each in one text, of which just their first tokens begin with a space."""
        out: dict[str, bytes] = {}
        plain = [w for w in texts if len(w) > 1 and w[0] == " " and w[1:].strip() == w[1:]]  # no white space at either end behind the space
        known = [w for w in plain if self.cuts and _KNOWN(w)]
        other = sorted(set(plain).difference(known))
        for solve, some in ((self._by_parts, known), (self._by_text, other)):
            if some:
                out.update(zip(some, solve("".join(some), len(some))))
        return [out[w] if w in out else self._whole(w) for w in texts]

    def _by_text(self, text: str, n: int) -> list[bytes]:
        return self._slices(np.array(self._ids(text), "<u4"), n)

    def _by_parts(self, text: str, n: int) -> list[bytes]:
        """The text is cut here and each distinct part merged once, for many words share their parts."""
        parts = pa.array(_PARTS(text)).dictionary_encode()
        flat, begin, end = self.parts.places(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        return self._slices(_stretch.spread(flat, begin, end, parts.indices.to_numpy())[0], n)

    def _merge(self, parts: list[str]) -> list[bytes]:
        """By the library's model alone, to which bytes are shown as characters."""
        shown = _SHOWN[np.frombuffer("\0".join(parts).encode(), np.uint8)].tobytes().decode("utf-32-le").split(chr(_SHOWN[0]))
        tokens, ends, merge = [], [0], self.tokenizer.model.tokenize
        for part in shown:
            tokens += merge(part)
            ends.append(4 * len(tokens))
        raw = np.fromiter(map(attrgetter("id"), tokens), "<u4", len(tokens)).tobytes()
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def _slices(self, ids: np.ndarray, n: int) -> list[bytes]:
        """The ids of n words that stand behind a space each."""
        at = np.flatnonzero(self.opens[ids])
        if len(at) != n or at[0]:
            raise ValueError("tokens pass a space")
        raw, ends = ids.tobytes(), [*(4 * at[1:]).tolist(), 4 * len(ids)]
        return [raw[a:b] for a, b in zip((4 * at).tolist(), ends)]

    def _ids(self, text: str) -> list[int]:
        """By the library's form that keeps no places in the text."""
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _whole(self, text: str) -> bytes:
        return np.array(self._ids(text), "<u4").tobytes()

    def many(self, col: pa.Array) -> list[np.ndarray]:
        return self.stretches.encode(col)


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _shards(docs: DataFrame) -> int:
    """One for each SHARD_BYTES by the plan's own estimate of its size, and as many as there are shuffle partitions at least."""
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 60  # rows without files have no estimate
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES) if known else 1)


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, kind: str = "byte", shards: int | None = None) -> DataFrame:
    """Writes all texts' ids in ascending order of id_col, one file per range of ids. Returns per file: shard, path, n_docs, n_ids."""
    spark = docs.sparkSession
    _util.ship(spark)
    n = shards or _shards(docs)
    # random placement inside a run of equal ids can't matter: equal ids fall into one range
    ordered = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    end = np.array([end_id], "<u4")

    def write(batches):
        encoder, writer, sink, shard = None, None, None, TaskContext.get().partitionId()
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        part = f"{root}/.part-{shard}-{uuid.uuid4().hex}"
        for batch in _util.steps(batches, "text", STEP_BYTES):
            if writer is None:
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(part)
                encoder, writer = encoder_of(tokenizer_path), Writer(sink, kind)
            for d, ids in zip(batch.column("doc_id").to_pylist(), encoder.many(batch.column("text"))):
                writer.add(d, np.concatenate((ids, end)))
        if writer is not None:
            writer.close()
            sink.close()
            path = f"{root}/shard-{shard:06d}.planes"
            fs.move(part, path)
            yield pa.record_batch([pa.array([shard]), pa.array([path]), pa.array([len(writer.docs)]), pa.array([writer.total])], names=["shard", "path", "n_docs", "n_ids"])

    return _util.cut(ordered.mapInArrow(write, "shard bigint, path string, n_docs bigint, n_ids bigint"))


def read_documents(manifest: DataFrame, folder: str, digest: bool = True) -> DataFrame:
    """Reads the files back. Per document: doc_id, start, n_tokens, and ids_crc32 or (digest False) the ids themselves as ids."""
    spark = manifest.sparkSession
    _util.ship(spark)
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per file, and about one file per task
    files = manifest.withColumn("before", before).repartitionByRange(max(manifest.count(), 1), "shard")

    def read(batches):
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
                with fs.open_input_file(path) as f:
                    rows: list[tuple] = []
                    held = 0
                    for doc, ids in Reader(f, f.size()).documents():
                        rows.append((doc, before, len(ids), zlib.crc32(ids.tobytes()) if digest else ids.tolist()))
                        before += len(ids)
                        held += 0 if digest else len(ids)
                        if len(rows) >= 10_000 or held > 1 << 20:
                            yield _batch(rows, digest)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows, digest)

    return files.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, " + ("ids_crc32 bigint" if digest else "ids array<bigint>"))


def _batch(rows: list[tuple], digest: bool) -> pa.RecordBatch:
    cols = list(zip(*rows))
    kinds = [pa.int64()] * 3 + [pa.int64() if digest else pa.list_(pa.int64())]
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])


def round_trip(docs: list[tuple[int | None, np.ndarray]], kind: str = "byte", block: int = BLOCK) -> list[tuple[int | None, np.ndarray]]:
    """Writes to memory and reads back."""
    f = io.BytesIO()
    w = Writer(f, kind, block)
    for d, ids in docs:
        w.add(d, ids)
    w.close()
    return list(Reader(f, f.tell()).documents())
