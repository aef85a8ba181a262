"""Ids of texts from the ids of their stretches between spaces, each distinct stretch solved once.

A worker process keeps what it has solved from task to task, up to a bound of
stretches and of bytes; stretches of more than ``LONG`` characters are never
kept, so a text of any shape holds memory only while it is solved.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most stretches of a generation, and most bytes of their ids and characters; a worker remembers two generations.
LIMIT, LIMIT_BYTES = 450_000, 1 << 26
#: Characters from which on a stretch is solved anew each time.
LONG = 1000


def spread(flat: np.ndarray, begin: np.ndarray, end: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the stretches named by codes in a row, and where each one's end."""
    n = (end - begin)[codes]
    ends = np.cumsum(n)
    return flat[np.repeat(begin[codes] - (ends - n), n) + np.arange(int(ends[-1]))], ends


class _Table:
    """Stretches by number; their ids stand one after another in flat."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)
        self.chars = 0

    def put(self, ids: list[bytes]) -> np.ndarray:
        """Writes ids behind those of the known stretches, where the next ones will be written too; returns where each begins and the last ends."""
        return self._write(np.frombuffer(b"".join(ids), np.uint32), np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4))

    def _write(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        used = int(self.ends[len(self.index)])
        if used + len(raw) > len(self.flat):
            self.flat = np.concatenate((self.flat[:used], np.empty(used + 2 * len(raw), np.uint32)))
        self.flat[used : used + len(raw)] = raw
        return used + np.concatenate(([0], ends))

    def add(self, keys: list[str], ids: list[bytes]) -> None:
        self._name(keys, self.put(ids))

    def bring(self, keys: list[str], old: _Table, known: np.ndarray) -> None:
        """Adds stretches of another table, by their numbers there."""
        self._name(keys, self._write(*spread(old.flat, old.ends[known], old.ends[known + 1], np.arange(len(known)))))

    def _name(self, keys: list[str], cuts: np.ndarray) -> None:
        n = len(self.index)
        if n + len(keys) + 1 > len(self.ends):
            self.ends = np.concatenate((self.ends[: n + 1], np.zeros(n + 2 * len(keys), np.int64)))
        self.ends[n + 1 : n + 1 + len(keys)] = cuts[1:]
        self.index.update(zip(keys, range(n, n + len(keys))))
        self.chars += sum(map(len, keys))

    def full(self, limit: int) -> bool:
        n = len(self.index)
        return n > limit or 4 * int(self.ends[n]) + self.chars > LIMIT_BYTES


class Stretches:
    """solve gives the ids of stretches as bytes of 32-bit integers; whole those of a text that can't be cut.

    With lead, the first stretch of a text goes to solve behind a space, which
    tells it from the same stretch after a space. uncut is a regular expression
    (RE2) for texts to take whole.
    """

    def __init__(self, solve: Callable[[list[str]], list[bytes]], whole: Callable[[str], bytes], uncut: str, lead: bool, limit: int = LIMIT):
        self.solve, self.whole, self.uncut, self.lead, self.limit = solve, whole, uncut, lead, limit
        self.young, self.old = _Table(), _Table()

    def places(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in a row, and where each key's begin and end.

        What is used stays: a full generation becomes the old one, from which
        later uses bring stretches back.
        """
        if self.young.full(self.limit):
            self.old, self.young = self.young, _Table()
        young, old = self.young, self.old
        at = np.fromiter(map(young.index.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(at < 0)
        once = [i for i in missing.tolist() if len(keys[i]) > LONG]
        if len(missing):
            if once:
                missing = np.setdiff1d(missing, once)
            words = [keys[i] for i in missing.tolist()]
            known = np.fromiter(map(old.index.get, words, repeat(-1)), np.int64, len(words))
            order = np.argsort(known < 0, kind="stable")  # those of the older generation first
            known = known[known >= 0]
            names = [words[i] for i in order.tolist()] if len(known) else words
            at[missing[order]] = len(young.index) + np.arange(len(words))
            if len(known):
                young.bring(names[: len(known)], old, known)
            if len(known) < len(names):
                young.add(names[len(known) :], self.solve(names[len(known) :]))
        begin, end = young.ends[at], young.ends[at + 1]
        if once:
            cuts = young.put(self.solve([keys[i] for i in once]))
            begin[once], end[once] = cuts[:-1], cuts[1:]
        return young.flat, begin, end

    def encode(self, col: pa.Array) -> list[np.ndarray]:
        """Per row of a string column without nulls its ids."""
        if not len(col):
            return []
        odd = np.flatnonzero(pc.match_substring_regex(col, self.uncut).to_numpy(zero_copy_only=False))
        apart = {int(i): self.whole(col[int(i)].as_py()) for i in odd}
        if len(odd):
            mask = np.zeros(len(col), bool)
            mask[odd] = True
            col = pc.if_else(pa.array(mask), "", col)
        lists = pc.split_pattern(col, " ")
        offs = lists.offsets.to_numpy()
        offs = offs - offs[0]
        words = lists.flatten().dictionary_encode()
        codes = words.indices.to_numpy().astype(np.int64)
        kinds = words.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than a list of scalars
        if self.lead:
            heads = words.dictionary.take(pa.array(codes[offs[:-1]])).dictionary_encode()
            codes[offs[:-1]] = len(kinds) + heads.indices.to_numpy()
            kinds += [" " + k for k in heads.dictionary.to_pylist()]
        flat, begin, end = self.places(kinds)
        ids, ends = spread(flat, begin, end, codes)
        cuts = np.concatenate(([0], ends))[offs]
        return [np.frombuffer(apart[i], np.uint32) if i in apart else ids[a:b] for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()))]
