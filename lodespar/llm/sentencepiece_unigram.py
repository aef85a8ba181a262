"""SentencePiece encoding and decoding by a Unigram model.

The text, with a marker for each space and one before all, is cut into pieces
so that the sum of the pieces' log scores is largest (Viterbi). Pieces are
found in a double-array trie over UTF-8 bytes. A character that is no piece
has an unknown piece, ten below the lowest score, and is written as its bytes'
pieces. Decoding joins the pieces, turns markers back into spaces and drops the
first.

The public vocabulary holds ranks of merges, not probabilities. As log scores
pieces get those of Zipf's law over their rank: ln(1 / rank) less the logarithm
of the sum over all ranks.

Pieces never hold a marker after another character, so a text is cut before
runs of markers and each distinct stretch is solved once, many stretches at a
time; long ones are solved alone.

Where two ways to cut a stretch score the same, that with the earlier beginning
of its last piece stays. Edge cases: null and empty texts have no piece and
decode to "". A text's own marker characters count as spaces. A text of any
length is encoded whole, some stretches at a time. Rows repeat as given. Other
columns don't matter to encode(); decode() keeps them, and a column of the name
that it is told to give is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _stretch, _util

MARK = "▁"
_MARK = MARK.encode()
#: Stretches of more bytes are solved one by one.
LONG = 96
#: Stretches that a worker keeps from task to task, and that are solved at once.
KEPT, AT_ONCE = 120_000, 20_000


class DoubleArray:
    """base[s] + byte is the next state where check of it is s; value[s] is the id of the piece that ends there, or -1."""

    def __init__(self, pieces: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for piece, i in sorted(pieces.items()):
            node = 0
            for b in piece:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = nxt
            ends[node] = i
        size = 2 * len(children) + 16384
        used = np.zeros(size, bool)
        used[0] = True
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        queue, first = [(0, 0)], 1
        for node, state in queue:
            value[state] = ends[node]
            keys = sorted(children[node])
            if not keys:
                continue
            while used[first]:
                first += 1
            at = max(first - keys[0], 1)
            while True:  # the first place from there where all children fit, 4096 places at a time
                if at + 8192 >= len(used):
                    grow = len(used)
                    used = np.concatenate((used, np.zeros(grow, bool)))
                    base, check, value = (np.concatenate((a, np.full(grow, v, np.int32))) for a, v in ((base, 0), (check, -1), (value, -1)))
                taken = np.zeros(4096, bool)
                for b in keys:
                    taken |= used[at + b : at + b + 4096]
                if not taken.all():
                    at += int(taken.argmin())
                    break
                at += 4096
            base[state] = at
            for b in keys:
                used[at + b] = True
                check[at + b] = state
                queue.append((children[node][b], at + b))
        end = int(np.flatnonzero(used)[-1]) + 257
        self.base, self.check, self.value = base[:end], check[:end], value[:end]


class Model:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = sp.id_to_piece(list(range(n)))
        self.byte_ids = np.zeros(256, np.int32)
        self.text = [b""] * n
        normal: dict[bytes, int] = {}
        for i, p in enumerate(names):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.text[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal[p.encode()] = i
                self.text[i] = p.encode()
                if MARK in p.lstrip(MARK):
                    raise ValueError(f"a piece has a marker inside: {p!r}")
        order = sorted(normal.values())
        scores = -np.log(np.arange(1, len(order) + 1)) - np.log((1 / np.arange(1, len(order) + 1)).sum())
        self.scores = np.zeros(n, np.float32)
        self.scores[order] = scores
        self.unknown = np.float32(self.scores[order].min() - np.float32(10))
        self.trie = DoubleArray(normal)

    def solve_one(self, raw: bytes) -> list[int]:
        """Viterbi over one stretch of any length."""
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n = len(raw)
        best = np.full(n + 1, -np.inf, np.float32)
        best[0] = 0
        back = np.zeros(n + 1, np.int32)
        piece = np.full(n + 1, -1, np.int32)
        for s in range(n):
            if (raw[s] & 0xC0) == 0x80 and not np.isfinite(best[s]):
                continue
            char = _char(raw[s])
            node, single = 0, False
            for e in range(s, n):
                nxt = int(base[node]) + raw[e]
                if check[nxt] != node:
                    break
                node = nxt
                v = int(value[node])
                if v >= 0:
                    x = best[s] + scores[v]
                    if x > best[e + 1]:
                        best[e + 1], back[e + 1], piece[e + 1] = x, s, v
                    single |= e + 1 - s == char
            e = min(s + char, n)
            if not single and best[s] + self.unknown > best[e]:
                best[e], back[e], piece[e] = best[s] + self.unknown, s, -1
        out: list[int] = []
        e = n
        while e:
            s = int(back[e])
            out.extend([int(piece[e])] if piece[e] >= 0 else [int(self.byte_ids[b]) for b in reversed(raw[s:e])])
            e = s
        return out[::-1]

    def solve(self, stretches: list[bytes]) -> list[list[int]]:
        """Viterbi over many short stretches at once, position by position."""
        out: list[list[int]] = [[] for _ in stretches]
        some = [i for i, x in enumerate(stretches) if 0 < len(x) <= LONG]
        for i, x in enumerate(stretches):
            if len(x) > LONG:
                out[i] = self.solve_one(x)
        if not some:
            return out
        some.sort(key=lambda i: -len(stretches[i]))
        size = np.array([len(stretches[i]) for i in some])
        n, top = len(some), int(size[0])
        flat = np.frombuffer(b"".join(stretches[i] for i in some), np.uint8)
        raw = np.zeros((top, n), np.uint8)
        col = np.repeat(np.arange(n), size)
        raw[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), col] = flat
        width = _CHAR[raw]
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        best = np.full((top + 1, n), -np.inf, np.float32)
        best[0] = 0
        back = np.zeros((top + 1, n), np.int16)
        piece = np.full((top + 1, n), -1, np.int32)
        live = np.searchsorted(-size, -np.arange(top + 1), "left")  # stretches of more than so many bytes come first
        for s in range(top):
            at = np.flatnonzero(np.isfinite(best[s, : live[s]]))
            if not len(at):
                continue
            start = best[s, at]
            single = np.zeros(n, bool)
            node, a, sc = np.zeros(len(at), np.int64), at, start
            for e in range(s, top):
                on = a < live[e]
                if not on.all():
                    a, node, sc = a[on], node[on], sc[on]
                nxt = base[node] + raw[e, a]
                on = check[nxt] == node
                a, node, sc = a[on], nxt[on], sc[on]
                if not len(a):
                    break
                v = value[node]
                end = np.flatnonzero(v >= 0)
                if len(end):
                    b, vv = a[end], v[end]
                    x = sc[end] + scores[vv]
                    up = x > best[e + 1, b]
                    b, vv = b[up], vv[up]
                    best[e + 1, b], back[e + 1, b], piece[e + 1, b] = x[up], s, vv
                    b = a[end]
                    single[b[width[s, b] == e + 1 - s]] = True
            rest = at[~single[at]]
            if len(rest):
                e = np.minimum(s + width[s, rest], size[rest])
                x = best[s, rest] + self.unknown
                up = x > best[e, rest]
                e, rest = e[up], rest[up]
                best[e, rest], back[e, rest], piece[e, rest] = x[up], s, -1
        # walk back all stretches together; the steps come out last first
        pos = size.copy()
        which = np.arange(n)
        cols, starts, ends, ids = [], [], [], []
        while len(which):
            p = pos[which]
            s = back[p, which].astype(np.int64)
            cols.append(which)
            starts.append(s)
            ends.append(p)
            ids.append(piece[p, which])
            pos[which] = s
            which = which[s > 0]
        cols, starts, ends, ids = (np.concatenate(x) for x in (cols, starts, ends, ids))
        order = np.lexsort((starts, cols))
        for c, s, e, v in zip(cols[order].tolist(), starts[order].tolist(), ends[order].tolist(), ids[order].tolist()):
            if v >= 0:
                out[some[c]].append(v)
            else:
                out[some[c]].extend(int(self.byte_ids[b]) for b in stretches[some[c]][s:e])
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = self.text
        return b"".join([text[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(MARK, " ")[1:]


def _char(b: int) -> int:
    return 1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4


_CHAR = np.array([_char(b) for b in range(256)], np.int64)
_RUNS = re.compile(r" +[^ ]*")


class Encoder:
    """Encodes whole texts; each stretch stands for itself with a marker before it, and texts with runs of spaces are cut apart."""

    def __init__(self, model: Model, limit: int = KEPT):
        self.model = model
        self.stretches = _stretch.Stretches(self._solve, self._whole, f"^ |  |{MARK}", False, limit)

    def _solve(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(words), AT_ONCE):
            out += [np.array(x, np.uint32).tobytes() for x in self.model.solve([_MARK + w.encode() for w in words[i : i + AT_ONCE]])]
        return out

    def _whole(self, text: str) -> bytes:
        """A text with runs of spaces, AT_ONCE stretches at a time, so that its length needs no memory but for its ids."""
        runs = (m[0] for m in _RUNS.finditer(" " + text.replace(MARK, " ")))
        out = []
        while part := list(islice(runs, AT_ONCE)):
            kinds = {r: i for i, r in enumerate(dict.fromkeys(part))}
            ids = [np.array(x, np.uint32).tobytes() for x in self.model.solve([r.replace(" ", MARK).encode() for r in kinds])]
            out.append(b"".join([ids[kinds[r]] for r in part]))
        return b"".join(out)

    def many(self, col: pa.Array) -> list[np.ndarray]:
        """Per text its ids; an empty text has none."""
        empty = pc.equal(col, "").to_numpy(zero_copy_only=False)
        return [x[:0] if e else x for x, e in zip(self.stretches.encode(col), empty)]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str, model: Model) -> Encoder:
    """One per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(model)
    return _encoders[path]


_models: dict[str, Model] = {}


def load(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Per row: the id, n_pieces, n_bytes (pieces of byte fallback) and ids; with digest ids_crc32 and decoded_same in place of ids."""
    spark = docs.sparkSession
    _util.ship(spark)
    shared = spark.sparkContext.broadcast(load(model_path))

    def run(batches):
        encoder = _encoder(model_path, shared.value)
        byte = np.zeros(len(shared.value.text), bool)
        byte[shared.value.byte_ids] = True
        for batch in _util.steps(batches, "text"):
            texts = batch.column("text").to_pylist()
            ids = encoder.many(batch.column("text"))
            counts = [len(x) for x in ids]
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            total = np.concatenate(([0], np.cumsum(byte[flat])))
            ends = np.cumsum(counts)
            cols = [batch.column("id"), pa.array(counts, pa.int64()), pa.array(total[ends] - total[ends - counts])]
            if digest:
                same = [encoder.model.decode(x) == t.replace(MARK, " ") for x, t in zip(ids, texts)]
                cols += [pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array(same)]
                yield pa.record_batch(cols, names=["id", "n_pieces", "n_bytes", "ids_crc32", "decoded_same"])
            else:
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(flat)))
                yield pa.record_batch(cols, names=["id", "n_pieces", "n_bytes", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, n_pieces bigint, n_bytes bigint, " + ("ids_crc32 bigint, decoded_same boolean" if digest else "ids array<int>"))
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """Adds the decoded text of each row's ids; null ids give a null text."""
    spark = encoded.sparkSession
    _util.ship(spark)
    shared = spark.sparkContext.broadcast(load(model_path))

    def run(col: pa.Array) -> pa.Array:
        return pa.array([None if x is None else shared.value.decode(np.asarray(x, np.int64)) for x in col.to_pylist()], pa.string())

    return encoded.withColumn(out, F.arrow_udf(run, "string").asNondeterministic()(F.col(ids_col)))
