"""Quality rules: line labels by a linear-chain conditional random field.

Every line with a word gets a few numbers between 0 and 1; Viterbi decoding of a two-state chain
marks it as content or boilerplate, and the content's share of the text's characters decides
whether the document stays.  Two plain rules on words come first (``base_failed``).

The field is fitted on the driver on a bounded sample of labelled documents: ``TRAIN_DOCS`` per
class, the first ``TRAIN_LINES`` lines of each, ``TRAIN_CHARS`` characters at most.  Lines of good documents are content; lines of bad
ones start as boilerplate and are relabelled once by the first fit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slices, prepare, text_or_empty
from .words import Words, code_points_before, mix, utf8

TRAIN_DOCS = 600
TRAIN_LINES = 60
TRAIN_CHARS = 20_000
#: Least share of characters in content lines.
CONTENT_SHARE = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _LOWER, _DIGIT, _STOP = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_STOP[list(b".!?:;")] = True
_BLANK = " \t\n\x0b\x0c\r"

FEATURES = ("one", "symbols", "bars", "upper", "shouted", "exclaims", "digits", "repeats", "copies", "short", "long", "stop", "again")
BOILERPLATE, CONTENT = 0, 1


@dataclass
class Lines:
    """Lines with a word of several texts: features, size in code points, first line of each text,
    and per text the words' and lines' counts."""

    x: np.ndarray
    size: np.ndarray
    first: np.ndarray
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


def _repeated_words(w: Words) -> np.ndarray:
    """Per text the words that lie in a window of three words found twice or more in it."""
    h, n = w.hash, len(w.hash)
    out = np.zeros(len(w.off) - 1, "i8")
    if n < 3:
        return out
    text = np.repeat(np.arange(len(out)), w.per_text)
    at = np.flatnonzero(text[:-2] == text[2:])
    window = mix(mix(mix(h[at]) ^ h[at + 1]) ^ h[at + 2])
    window = mix(window ^ text[at].astype(np.uint64))  # of its own text
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for j in range(3):
        covered[at[twice] + j] = True
    np.add.at(out, text[covered], 1)
    return out


def lines_of(column: pa.Array) -> Lines:
    raw, off = utf8(column)
    w = Words(raw, off)
    cp = code_points_before(raw)
    texts = len(off) - 1
    breaks = np.unique(np.concatenate([np.flatnonzero(raw == 10), off]))
    key = np.searchsorted(breaks, w.starts, "right")
    head = np.ones(len(key), bool)
    head[1:] = (key[1:] != key[:-1]) | (np.searchsorted(off, w.starts[1:], "right") != np.searchsorted(off, w.starts[:-1], "right"))
    a = np.flatnonzero(head)  # first word of each line
    b = np.append(a[1:], len(key))
    first = np.searchsorted(a, w.first)
    lo, hi = (w.starts[a], w.ends[b - 1]) if len(a) else (np.empty(0, "i8"), np.empty(0, "i8"))
    words = (b - a).astype(float)

    def per_line(table: np.ndarray) -> np.ndarray:
        s = _sums(table[raw])
        return s[hi] - s[lo]

    def words_per_line(flags: np.ndarray) -> np.ndarray:
        s = _sums(flags)
        return s[b] - s[a]

    sym = _sums(_SYMBOL[raw])
    size = cp[hi] - cp[lo]
    upper, lower = per_line(_UPPER), per_line(_LOWER)
    letters = np.maximum(1, upper + lower)
    echo = np.zeros(len(key), bool)
    if len(key) > 1:
        echo[1:] = (w.hash[1:] == w.hash[:-1]) & ~head[1:]
    line_of = np.repeat(np.arange(len(a)), b - a)
    within = mix(w.hash ^ mix(line_of.astype(np.uint64))) if len(key) else w.hash
    order = np.argsort(within, kind="stable")
    copy = np.zeros(len(key), bool)
    copy[order[1:][within[order][1:] == within[order][:-1]]] = True
    last = raw[w.ends - 1] if len(key) else raw[:0]
    before = raw[np.maximum(w.ends - 2, 0)] if len(key) else raw[:0]

    again, dup = np.zeros(len(a), bool), np.zeros(texts, "i8")
    k = 0
    for i, text in enumerate(column.to_pylist()):
        seen = set()
        for line in (text or "").split("\n"):
            if line.strip(_BLANK):
                if line in seen:
                    again[k] = True
                    dup[i] += 1
                else:
                    seen.add(line)
                k += 1
    if k != len(a):
        raise AssertionError("lines and words don't agree")

    x = np.stack(
        [
            np.ones(len(a)),
            words_per_line(sym[w.ends] > sym[w.starts]) / np.maximum(1, words),
            words_per_line((w.ends - w.starts == 1) & (last == ord("|"))) / np.maximum(1, words),
            upper / letters,
            (upper > 0.7 * letters) & (letters > 3),
            words_per_line((last == ord("!")) & (before == ord("!"))) / np.maximum(1, words),
            per_line(_DIGIT) / np.maximum(1, size),
            words_per_line(echo) / np.maximum(1, words),
            words_per_line(copy) / np.maximum(1, words) * (words >= 20),
            words <= 3,
            np.minimum(1, words / 60),
            _STOP[raw[np.maximum(hi - 1, 0)]] if len(a) else np.empty(0),
            again,
        ],
        axis=1,
    ).astype(float)
    chars = cp[w.ends] - cp[w.starts] if len(key) else np.empty(0, "i8")
    total, text_sym = _sums(chars), sym[off]
    return Lines(x, size, first, w.per_text, total[w.first[1:]] - total[w.first[:-1]], np.diff(text_sym), dup, _repeated_words(w))


class Field:
    """A linear-chain conditional random field of two states."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def _columns(self, first: np.ndarray):
        """Texts by falling number of lines, and for each place the lines there."""
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        starts, n = first[:-1][order], n[order]
        alive = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), "left")  # texts with more lines than t
        return starts, n, alive

    def viterbi(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best state of each line."""
        emit = x @ self.weights.T
        starts, n, alive = self._columns(first)
        back = np.zeros((len(x), 2), "i1")
        state = np.zeros(len(x), "i1")
        score = np.zeros((len(n), 2))
        for t, m in enumerate(alive):
            at = starts[:m] + t
            if t:
                via = score[:m, :, None] + self.moves
                back[at] = via.argmax(1)
                score[:m] = via.max(1) + emit[at]
            else:
                score[:m] = emit[at]
        best = score.argmax(1).astype("i1")
        for t in range(len(alive) - 1, -1, -1):
            at = starts[: alive[t]] + t
            state[at] = best[: alive[t]]
            best[: alive[t]] = back[at, best[: alive[t]]]
        return state

    def gradient(self, x: np.ndarray, y: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the log-likelihood of the states ``y``: observed less expected counts."""
        emit = x @ self.weights.T
        starts, n, alive = self._columns(first)
        fwd, bwd = np.zeros((len(x), 2)), np.zeros((len(x), 2))
        for t, m in enumerate(alive):
            at = starts[:m] + t
            fwd[at] = emit[at] + (np.logaddexp.reduce(fwd[at - 1][:, :, None] + self.moves, axis=1) if t else 0)
        pair = np.zeros((2, 2))
        ends = starts + n - 1
        norm = np.zeros(len(n))
        full = n > 0
        norm[full] = np.logaddexp.reduce(fwd[ends[full]], axis=1)
        for t in range(len(alive) - 2, -1, -1):
            m = alive[t + 1]
            at = starts[:m] + t
            on = self.moves + (emit[at + 1] + bwd[at + 1])[:, None, :]
            bwd[at] = np.logaddexp.reduce(on, axis=2)
            pair += np.exp(fwd[at][:, :, None] + on - norm[:m, None, None]).sum(0)
        of = np.repeat(norm[np.argsort(np.argsort(-np.diff(first), kind="stable"))], np.diff(first))
        p = np.exp(fwd + bwd - of[:, None])
        seen = np.zeros((2, 2))
        inner = np.ones(len(x), bool)
        inner[first[:-1][np.diff(first) > 0]] = False
        at = np.flatnonzero(inner)
        np.add.at(seen, (y[at - 1], y[at]), 1)
        return (np.eye(2)[y] - p).T @ x, seen - pair


def fit(x: np.ndarray, y: np.ndarray, first: np.ndarray, rounds: int = 400, ridge: float = 1e-4) -> Field:
    """Maximum likelihood with a small ridge, by Adam on full gradients from zero weights."""
    field = Field(np.zeros((2, x.shape[1])), np.zeros((2, 2)))
    theta = [field.weights, field.moves]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for r in range(1, rounds + 1):
        for i, g in enumerate(field.gradient(x, y, first)):
            g = g / max(1, len(x)) - ridge * theta[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            theta[i] += 0.3 * (m[i] / (1 - 0.9**r)) / (np.sqrt(v[i] / (1 - 0.99**r)) + 1e-8)
    return field


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCS, lines: int = TRAIN_LINES) -> Field | None:
    """A field fitted on a bounded sample: ``per_class`` labelled documents of either quality, by
    the hash of their ids.  None where the labels don't hold both classes."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = [known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    # at most 2 * per_class rows of two numbers: a proven bound
    sample = F.broadcast(picked[0].unionByName(picked[1]))
    head = F.substring(F.array_join(F.slice(F.split(text_or_empty(), "\n"), 1, lines), "\n"), 1, TRAIN_CHARS).alias("text")
    sampled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), head).join(sample, "doc_id")
    # of rows that share an id the smallest text: a row for each sampled id
    rows = sampled.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.text))
    if len({r.quality for r in rows}) < 2:
        return None
    found = lines_of(pa.array([r.text for r in rows], pa.string()))
    good = np.repeat(np.array([r.quality for r in rows]), np.diff(found.first))
    field = fit(found.x, good, found.first)
    y = np.where(good == 1, CONTENT, field.viterbi(found.x, found.first))
    return fit(found.x, y, found.first) if len(set(y.tolist())) == 2 else field


def quality(docs: DataFrame, field: Field | None, content_share: float = CONTENT_SHARE) -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``content_share`` and ``kept`` added, row by row.

    A null text has no words and fails the base rules, as an empty one does; its content share is 0.
    Repeated rows and ties are judged alike; columns of ``docs`` with one of the added names are
    replaced; without a field (no labels) every line counts as content.  All lines of a text of any
    length are labelled; a very long one comes alone.  An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    added = [
        pa.field(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    ] + [pa.field("content_share", pa.float64())]
    names = {f.name for f in added} | {"base_failed", "kept"}
    kept_columns = [c for c in docs.columns if c not in names]
    rows = docs.select(*kept_columns)
    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"{f.name} {'double' if f.name == 'content_share' else 'long'}" for f in added])

    def kernel(part: pa.RecordBatch) -> dict:
        found = lines_of(part.column("text").cast(pa.large_string()).fill_null(""))
        state = field.viterbi(found.x, found.first) if field is not None else np.full(len(found.x), CONTENT)
        good, every = _sums(found.size * (state == CONTENT)), _sums(found.size)
        share = (good[found.first[1:]] - good[found.first[:-1]]) / np.maximum(1, every[found.first[1:]] - every[found.first[:-1]])
        out = {c: part.column(c) for c in kept_columns}
        return out | {
            "n_words": found.n_words,
            "word_chars": found.word_chars,
            "n_symbols": found.n_symbols,
            "n_dup_lines": found.n_dup_lines,
            "n_repeat_words": found.n_repeat_words,
            "content_share": share,
        }

    def run(batches):
        for batch in batches:
            schema = pa.schema([batch.schema.field(c) for c in kept_columns] + added)
            yield from by_slices("text", schema, kernel)([batch])

    judged = rows.mapInArrow(run, types)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= content_share))
