"""Vectorised words, word hashes and shingles over Arrow string columns.

A word is a longest run of bytes other than space and \\t \\n \\v \\f \\r; in
UTF-8 that equals the run of code points. Hashes are 64 bits wide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {"p": np.ones(1, U), "q": np.ones(1, U)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        size = max(n, 1 << 17)
        for k, base in (("p", _BASE), ("q", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, base, U)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers["p"], _powers["q"]


def buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and where each row begins and the last one ends."""
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.string())
    wide = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, wide, len(col) + 1 + col.offset)[col.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


class Words:
    """The words of a column: start, end (bytes), doc (row number), per-row counts; hashes on demand."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, gaps: np.ndarray = _IS_SPACE):
        """gaps: for each byte whether it stands between words."""
        self.raw, self.offs = raw, offs
        n = len(raw)
        word = ~gaps[raw]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = word[:-1]
        self.start = np.flatnonzero(word & (~before | edge[:n]))
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = word[1:]
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.doc = np.searchsorted(offs, self.start, "right") - 1
        self.counts = np.bincount(self.doc, minlength=len(offs) - 1)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self._sums: np.ndarray | None = None

    @classmethod
    def of(cls, col: pa.Array) -> Words:
        return cls(*buffer(col))

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each span."""
        p, q = _pow(len(self.raw) + 1)
        if self._sums is None:
            s = np.empty(len(self.raw) + 1, U)
            s[0] = 0
            np.cumsum((self.raw.astype(U) + U(1)) * p[: len(self.raw)], out=s[1:])
            self._sums = s
        return mix((self._sums[end] - self._sums[start]) * q[start] + (end - start).astype(U))

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


def windows(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside a row, and the number of each run's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    x = np.zeros(len(at), U)
    for j in range(k):
        x = mix(x * U(0xD6E8FEB86659FD93) + hashes[at + j])
    return x, at


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) of each row's multiset of k-word shingles, sorted by row and shingle.

    A row of fewer than k words has all its words as one shingle; a row without a word has none.
    """
    h = w.hashes()
    x, at = windows(h, w.doc, k)
    row = w.doc[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        extra = np.full(len(short), 0x51ED270B, U)
        for j in range(k - 1):
            has = w.counts[short] > j
            extra[has] = mix(extra[has] * U(0xD6E8FEB86659FD93) + h[w.first[short[has]] + j])
        x, row = np.concatenate((x, extra)), np.concatenate((row, short))
    order = np.lexsort((x, row))
    x, row = x[order], row[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], x[at], np.diff(np.append(at, len(x)))
