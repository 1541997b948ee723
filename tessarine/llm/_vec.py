"""Whole Arrow text columns as byte arrays: words, their hashes and n-grams in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_POWERS = np.ones(1, np.uint64)

#: byte -> lower-cased byte (A-Z only)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: bytes of words: digits, lower-case ASCII letters, all of any other script
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: bytes of words: all but ASCII white space
SOLID = np.ones(256, bool)
SOLID[9:14] = SOLID[32] = False


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and n+1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1] if at is not None and n else np.zeros(n + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slabs(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole rows of about `most` bytes; a longer text is a run of its own."""
    n, row = len(offsets) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        a, b = int(offsets[row]), int(offsets[end])
        yield row, data[a:b], offsets[row : end + 1] - a
        row = end


def pieces(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20, ahead: int = 3) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """As slabs, but a longer text comes in pieces: (row, bytes, offsets, limit), where what starts before `limit` belongs to the piece.

    A piece ends at white space, wherever the next one is, so no word is cut. Behind its limit follow at least `ahead` bytes and the whole
    next word, so every n-gram, word and pair of words that starts in it is there in full and is counted in this piece only.
    """
    for row, part, at in slabs(data, offsets, most):
        if len(part) <= most:
            yield row, part, at, len(part)
            continue
        solid = SOLID[part]
        a, size = 0, len(part)
        while a < size:
            stop = a + most
            while stop < size and solid[stop]:
                gap = np.flatnonzero(~solid[stop : stop + 4096])
                stop = stop + int(gap[0]) if len(gap) else min(size, stop + 4096)
            stop = min(stop, size)
            end = stop
            for kind in (False, True):  # white space, then a word
                while end < size and solid[end] == kind:
                    other = np.flatnonzero(solid[end : end + 4096] != kind)
                    end = end + int(other[0]) if len(other) else min(size, end + 4096)
            end = min(size, max(end, stop + ahead))
            yield row, part[a:end], np.array([0, end - a]), stop - a
            a = stop


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        more = np.full(max(n, 64, 2 * len(_POWERS)), _BASE, np.uint64)
        more[0] = 1
        _POWERS = np.cumprod(more, dtype=np.uint64)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


class Words:
    """Words of a slab: byte starts and lengths, row, and a 64-bit hash of each word or of its first bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        solid = kind[data]
        start = solid.copy()
        start[1:] &= ~solid[:-1]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        start[first] = solid[first]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:]
        last = first[1:] - 1
        ends[last] = solid[last]
        self.start = np.flatnonzero(start)
        self.length = np.flatnonzero(ends) + 1 - self.start
        self.data = data
        self.at = np.searchsorted(self.start, offsets)  # words before each row
        self._sums: np.ndarray | None = None

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def _totals(self) -> np.ndarray:
        if self._sums is None:
            which = np.repeat(np.arange(len(self.start)), self.length)
            begun = np.cumsum(self.length) - self.length
            inside = np.arange(len(which)) - begun[which]
            byte = self.data[self.start[which] + inside].astype(np.uint64) + np.uint64(1)
            byte *= _powers(int(self.length.max(initial=0)) + 1)[inside]
            self._sums = np.zeros(len(byte) + 1, np.uint64)
            np.cumsum(byte, out=self._sums[1:])
            self._begun = begun
        return self._sums

    def hashes(self) -> np.ndarray:
        s = self._totals()
        return mix(s[self._begun + self.length] - s[self._begun])

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, hash of the first n bytes) of words that are longer than n."""
        s = self._totals()
        who = np.flatnonzero(self.length > n)
        return who, mix(s[self._begun[who] + n] - s[self._begun[who]] + np.uint64(n))


def hash_word(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), np.ones(256, bool)).hashes()[0]
