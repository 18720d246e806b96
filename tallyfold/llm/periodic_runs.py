"""Periodic runs of words: Lyndon roots from suffix arrays, extended by common prefixes both ways.

By the runs theorem every run has a root that is the longest Lyndon word at its place under one of two
orders of the words, an order and its reverse.  That word ends where the next suffix that is smaller
begins.  So a slice of texts is sorted under both orders, next smaller values of the inverse suffix
arrays give one candidate per place and order, and two longest common extensions (range minima over
the arrays of common prefixes of the slice and of its reverse) give the whole run.  Texts are cut apart
by marks that are smaller than all words and all different, so nothing extends beyond its text.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slices, prepare
from .words import Words, utf8

LEAST_WORDS, LEAST_PERIODS = 6, 4

_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
     ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
)
_DDL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def sort_suffixes(s: np.ndarray, levels: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """The inverse suffix array by prefix doubling, and with ``levels`` the ranks after each step.

    ``s`` ends with a value that is nowhere else and smaller than all.  Only places that are not yet
    alone in their bucket are sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    new = np.ones(n, bool)
    new[1:] = s[order[1:]] != s[order[:-1]]
    rank = np.empty(n, np.int32)
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = heads
    kept = [rank.copy()] if levels else []
    alone = new.copy()
    alone[:-1] &= new[1:]
    active, h = order[~alone], 1
    while len(active):
        first = rank[active].astype(np.int64)
        key = first * n + rank[active + h]
        o = np.argsort(key, kind="stable")
        active, first, key = active[o], first[o], key[o]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        bucket = np.ones(len(key), bool)
        bucket[1:] = first[1:] != first[:-1]
        at = np.arange(len(key))
        rank[active] = first + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(bucket, at, 0))
        if levels:
            kept.append(rank.copy())
        alone = new.copy()
        alone[:-1] &= new[1:]
        active = active[~alone]
        h *= 2
    return rank, kept


def common_prefixes(rank: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """For each place of the suffix array what its suffix has in common with the one before."""
    n = len(rank)
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    i, j = suffixes[:-1].copy(), suffixes[1:].copy()
    out = np.zeros(n, np.int32)
    for k in range(len(levels) - 1, -1, -1):
        same = np.flatnonzero(levels[k][i] == levels[k][j])
        out[same + 1] += 1 << k
        i[same] += 1 << k
        j[same] += 1 << k
    return out


class RangeMinimum:
    """A sparse table: minima of all windows whose lengths are powers of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        h = 1
        while 2 * h <= len(values):
            self.rows.append(np.minimum(self.rows[-1][:-h], self.rows[-1][h:]))
            h *= 2

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima from ``low`` to ``high``, both included."""
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.rows[0].dtype)
        for k in np.unique(level):
            m = np.flatnonzero(level == k)
            row = self.rows[k]
            out[m] = np.minimum(row[low[m]], row[high[m] - (1 << int(k)) + 1])
        return out


class Extensions:
    """Longest common prefixes of any two suffixes."""

    def __init__(self, s: np.ndarray):
        self.rank, levels = sort_suffixes(s, True)
        self.minimum = RangeMinimum(common_prefixes(self.rank, levels))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i].astype(np.int64), self.rank[j].astype(np.int64)
        return self.minimum(np.minimum(a, b) + 1, np.maximum(a, b)).astype(np.int64)


def next_smaller(values: np.ndarray) -> np.ndarray:
    """The next place with a smaller value; the number of places where there is none.

    Each place looks ahead over windows that double, then over halves of the one with a smaller value;
    few are still looking after some steps."""
    n = len(values)
    table = RangeMinimum(values)
    at = np.arange(1, n + 1)
    out = np.full(n, n, np.int64)
    looking, k = np.arange(n), 0
    while len(looking):
        h = 1 << k
        place = at[looking]
        whole = place + h <= n
        clear = np.zeros(len(looking), bool)
        if k < len(table.rows):
            clear[whole] = table.rows[k][place[whole]] > values[looking[whole]]
        done, place = looking[~clear], place[~clear]
        for below in range(min(k, len(table.rows)) - 1, -1, -1):  # a smaller value, or the end, comes within h places
            inside = place + (1 << below) <= n
            free = np.zeros(len(done), bool)
            free[inside] = table.rows[below][place[inside]] > values[done[inside]]
            place[free] += 1 << below
        out[done] = place
        looking = looking[clear]
        at[looking] += h
        k += 1
    return out


def runs(words: np.ndarray, first: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> tuple[np.ndarray, ...]:
    """All runs of at least ``least`` words and ``periods`` (two or more) periods: text, start, length, period,
    by text, start and period.  ``words`` are numbers, ``first`` where each text's begin (one more than texts)."""
    texts = len(first) - 1
    per = np.diff(first)
    _, number = np.unique(words, return_inverse=True)
    place = np.arange(len(words)) + np.repeat(np.arange(texts), per) + 1  # a mark before each text, and one at the end
    n = len(words) + texts + 1
    marks = np.concatenate([[0], first[1:] + np.arange(1, texts + 1)])
    s = np.empty(n, np.int64)
    s[place] = texts + 1 + number
    s[marks] = np.arange(texts + 1)[::-1]  # the last one is the smallest, in either direction
    back = s[::-1].copy()
    back[n - 1 - marks] = np.arange(texts + 1)
    forward = Extensions(s)
    other = s.copy()
    other[place] = texts + 1 + (number.max(initial=0) - number)
    roots = []
    for rank in (forward.rank, sort_suffixes(other, False)[0]):
        ends = next_smaller(rank)[place]
        repeats = np.flatnonzero((ends < n) & (s[place] == s[np.minimum(ends, n - 1)]))
        roots.append(np.stack([place[repeats], ends[repeats]]))
    i, j = np.unique(np.concatenate(roots, axis=1), axis=1)
    if not len(i):
        return tuple(np.empty(0, np.int64) for _ in range(4))
    right = forward(i, j)
    del forward
    left = Extensions(back)(n - i, n - j)
    period = j - i
    start, length = i - left, period + left + right
    keep = length >= np.maximum(least, periods * period)
    found = np.unique(np.stack([start[keep], period[keep], length[keep]]), axis=1)
    text = np.searchsorted(marks, found[0], side="right") - 1
    return text, found[0] - marks[text] - 1, found[2], found[1]


def _greatest(starts: list[int], lengths: list[int], periods: list[int]) -> tuple[int, int, int]:
    """The run of the greatest exponent, exactly; of ties the first."""
    best = (starts[0], lengths[0], periods[0])
    for run in zip(starts, lengths, periods, strict=True):
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def planted(n: int, doc_id: int | None) -> tuple[int, int] | None:
    """Where a text of the query is made periodic, and with which period; None for most ids and without one."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _kernel(repeat) -> callable:
    def kernel(part: pa.RecordBatch) -> dict:
        raw, off = utf8(pc.fill_null(part.column("text"), ""))
        words = Words(raw, off)
        first, ids = words.first, part.column("doc_id").to_pylist()
        source = np.arange(len(words.hash))
        for t, doc_id in enumerate(ids):
            a, b = int(first[t]), int(first[t + 1])
            if repeat is not None and (made := repeat(b - a, doc_id)) is not None:
                at, period = made
                source[a + at : b] = a + at + np.arange(b - a - at) % period
        text, start, length, period = runs(words.hash[source], first)
        edges = np.searchsorted(text, np.arange(len(ids) + 1))
        # words after the first period of a run are dropped
        cover = np.zeros(len(source) + 1, np.int64)
        np.add.at(cover, first[text] + start + period, 1)
        np.add.at(cover, first[text] + start + length, -1)
        kept = np.flatnonzero(np.cumsum(cover)[:-1] == 0)
        upto = np.searchsorted(kept, first)
        size = (words.ends - words.starts)[source[kept]]
        base = np.concatenate([[0], np.cumsum(size + 1)])
        joined = np.full(base[-1], 0x20, np.uint8)
        shift = np.repeat(words.starts[source[kept]] - (np.cumsum(size) - size), size)
        into = np.repeat(base[:-1] - (np.cumsum(size) - size), size) + np.arange(len(shift))
        joined[into] = raw[shift + np.arange(len(shift))]
        joined = memoryview(joined)
        out = {f.name: [] for f in _SCHEMA if f.name != "doc_id"}
        for t in range(len(ids)):
            m = slice(edges[t], edges[t + 1])
            found = [x[m].tolist() for x in (start, length, period)]
            best = _greatest(*found) if found[0] else (None, None, None)
            listed = "".join(f"{a},{b},{c}\n" for a, b, c in zip(*found, strict=True))
            a, b = int(base[upto[t]]), int(base[upto[t + 1]])
            out["n_runs"].append(len(found[0]))
            for name, value in zip(("start", "length", "period"), best, strict=True):
                out[name].append(value)
            out["exponent_milli"].append(1000 * best[1] // best[2] if found[0] else None)
            out["runs_sha256"].append(hashlib.sha256(listed.encode()).hexdigest())
            out["collapsed_sha256"].append(hashlib.sha256(joined[a : max(a, b - 1)]).hexdigest())
        return {"doc_id": part.column("doc_id"), **out}

    return kernel


def periodic_runs(docs: DataFrame, repeat=None) -> DataFrame:
    """Per document the number of its runs, the run of the greatest exponent, and digests of all runs and of
    the text without what repeats.

    A run is a stretch of words with a smallest period that fits four times at least, of six words at
    least, and longer on neither side.  ``repeat(n, doc_id)`` may name a place and a period from which on
    the words are made periodic first (see ``planted``).

    A null text is empty: no runs, digests of nothing.  Rows are judged one by one, so ties and repeated
    rows get equal results, and no rows give no rows.  Of runs with the same exponent the smallest start,
    then period, is shown.  A text without words collapses to the empty one.  Only ``doc_id`` and ``text``
    are read.  A very long text comes alone and needs some 80 bytes of a worker's memory for each byte.
    Words are compared by 64-bit hashes.
    """
    prepare(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(by_slices("text", _SCHEMA, _kernel(repeat)), _DDL)
