"""Vectorised words, shingles and their hashes over a column of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: ASCII white space, the only separators of words.
_SPACES = [0x20, *range(0x09, 0x0E)]
_IS_WORD = np.ones(256, bool)
_IS_WORD[_SPACES] = False
_SAME = np.arange(256, dtype=np.uint64)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32

_U = np.uint64
_GOLDEN, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64: a bijection that spreads every bit."""
    x = x + _GOLDEN
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


_table = mix(np.arange(1 << 12, dtype=np.uint64))


def _multipliers(n: int) -> np.ndarray:
    global _table
    if n > len(_table):
        _table = mix(np.arange(1 << int(n - 1).bit_length(), dtype=np.uint64))
    return _table[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after the other, and where each text starts (one more than texts)."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    off = np.frombuffer(column.buffers()[1], "<i8")[column.offset : column.offset + len(column) + 1]
    if len(off) == 0:
        off = np.zeros(1, "i8")
    data = column.buffers()[2]
    raw = np.frombuffer(data, "u1") if data is not None and data.size else np.empty(0, "u1")
    return raw[off[0] : off[-1]], off - off[0]


class Words:
    """Words of all texts of an Arrow column.

    ``starts``/``ends``: byte places; ``first``: index of each text's first word (one more than
    texts); ``hash``: 64 bits of each word.
    """

    def __init__(self, raw: np.ndarray, off: np.ndarray, lower: bool = False):
        self.raw, self.off = raw, off
        n = len(raw)
        inside = _IS_WORD[raw]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.ones(n, bool)
        before[1:] = ~inside[:-1]
        after = np.ones(n, bool)
        after[:-1] = ~inside[1:]
        self.starts = np.flatnonzero(inside & (before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, off)
        size = self.ends - self.starts
        self.hash = np.empty(0, np.uint64)
        if len(size):
            base = np.cumsum(size) - size
            place = np.arange(base[-1] + size[-1]) - np.repeat(base, size)
            values = (_LOWER if lower else _SAME)[raw[inside]] + _U(1)
            values *= _multipliers(int(size.max()))[place]
            self.hash = mix(np.add.reduceat(values, base) ^ (size.astype(np.uint64) << _U(48)))

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of ``k`` words that lie in one text, and the first of each text.

        A text of fewer words, but one at least, has its whole sequence as its only window.
        """
        n, per = len(self.hash), self.per_text
        count = np.where(per >= k, per - k + 1, np.minimum(per, 1))
        first = np.concatenate([[0], np.cumsum(count)])
        if not n:
            return np.empty(0, np.uint64), first
        place = np.arange(first[-1]) - np.repeat(first[:-1], count) + np.repeat(self.first[:-1], count)
        length = np.repeat(np.minimum(per, k), count)
        acc = np.zeros(first[-1], np.uint64)
        for j in range(k):
            acc = np.where(j < length, mix(acc ^ self.hash[np.minimum(place + j, n - 1)]), acc)
        return mix(acc ^ length.astype(np.uint64)), first


def distinct_per_text(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and the new first of each text."""
    texts = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, texts))
    v, t = values[order], texts[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    v, t = v[new], t[new]
    return v, np.searchsorted(t, np.arange(len(first)))


def code_points_before(raw: np.ndarray) -> np.ndarray:
    """Number of code points that start before each byte place (one more than bytes)."""
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
