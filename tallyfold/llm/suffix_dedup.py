"""Exact removal of repeated byte strings, by bucket-pointer refinement of suffixes.

Sorting all suffixes would move every byte position.  It is enough to bring together the positions
that can be equal for ``LENGTH`` bytes: each window of that length has an anchor, the smallest
``Q``-gram (by hash, the leftmost of equals) inside it, which depends on the window's bytes alone.

1. One scan hashes texts and finds, for each run of windows with one anchor, the run's whole
   context.  Equal contexts within a task are settled there and sent once.
2. Runs meet by anchor, those of the few heaviest anchors by anchor and context.  Equal contexts
   settle all their windows; an anchor with one run only has no repeat; what is left are the edges of
   repeats, different contexts of one anchor.  Rows stream by in order, so no task holds an anchor.
3. The bytes of these contexts meet by anchor, and their window positions are refined: buckets by
   64-grams, then twice by the buckets of later offsets, the second time by the updated ones
   (64, 128, ``LENGTH``); positions alone in a bucket drop out.  Buckets that keep two are repeats.
   Anchors with very many contexts are refined per window by a distributed count instead.
4. Each text's repeated windows are united and removed.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import forget
from .common import STEP_BYTES, Scratch, pieces, slices, text_or_empty
from .words import mix, utf8

LENGTH = 200
Q = 32
#: Runs that a task settles at a time, and bytes of contexts that one refinement holds.
SETTLE_RUNS, REFINE_BYTES = 400_000, 1_500_000
#: Contexts of one anchor beyond which windows are counted by a shuffle instead of in one task.
HOT_CONTEXTS = 20_000
#: An anchor with more than two in this many of all runs is dealt by its contexts, so at most this many are.
HEAVY = 10_000
#: Rows of one context that are held before all but two are passed on.
KEPT_RUNS = 100_000
#: Hot anchors up to which their list is broadcast (a long and a boolean each); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of a huge text that are looked at together.
PIECE = 1_000_000

_U = np.uint64
_BYTE = mix(np.arange(256, dtype=np.uint64) + _U(0x1000))
_P = _U(0x9E3779B97F4A7C15 | 1)
_P_INV = _U(pow(int(_P), -1, 1 << 64))
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, STEP_BYTES + 65_536)
        _powers[:] = [np.cumprod(np.concatenate([[_U(1)], np.full(size, x)])) for x in (_P, _P_INV)]
    return _powers[0], _powers[1]


class Rolling:
    """Hashes of any substring of some bytes."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _power(len(raw))
        self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)])

    def grams(self, q: int) -> np.ndarray:
        n = len(self.sum) - q
        return mix((self.sum[q:] - self.sum[:n]) * self.down[:n]) if n > 0 else np.empty(0, np.uint64)

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sum[b] - self.sum[a]) * self.down[a]


def _window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def runs(raw: np.ndarray, off: np.ndarray, length: int = LENGTH, q: int = Q):
    """Runs of windows with one anchor: (text, first start, last start, anchor hash, context hash),
    starts counted within the text."""
    n = len(raw)
    none = np.empty(0, "i8")
    if n < length:
        return none, none, none, none, none
    roll = Rolling(raw)
    gram = roll.grams(q)
    key = (gram & ~_U(0xFFFFFF)) | np.arange(len(gram), dtype=np.uint64)
    at = (_window_minimum(key, length - q + 1) & _U(0xFFFFFF)).astype("i8")
    step = np.zeros(n + 1, "i4")  # windows that would leave their text are none
    np.add.at(step, np.maximum(off[1:] - length + 1, off[:-1]), 1)
    np.add.at(step, off[1:], -1)
    at[np.cumsum(step)[: len(at)] > 0] = -1
    lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    hi = np.append(lo[1:], len(at)) - 1
    real = at[lo] >= 0
    lo, hi = lo[real], hi[real]
    where = at[lo]
    context = mix(roll.between(lo, hi + length) ^ mix(((where - lo) * 1024 + (hi - lo)).astype(np.uint64)))
    text = np.searchsorted(off, lo, "right") - 1
    return text, lo - off[text], hi - off[text], gram[where].view("i8"), context.view("i8")


def _pieces(raw: np.ndarray, off: np.ndarray, length: int):
    """The texts, a huge one in overlapping pieces: (bytes, offsets, first text, place in it)."""
    if len(raw) <= 2 * PIECE:
        yield raw, off, 0, 0
        return
    for i in range(len(off) - 1):
        text = raw[off[i] : off[i + 1]]
        for a in range(0, max(1, len(text) - length + 1), PIECE):
            part = text[a : a + PIECE + length - 1]
            yield part, np.array([0, len(part)]), i, a


def _merged(owner: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals [a, b) of owners, touching ones united."""
    order = np.lexsort((a, owner))
    owner, a, b = owner[order], a[order], b[order]
    if not len(a):
        return owner, a, b
    new = np.ones(len(a), bool)
    _, group = np.unique(owner, return_inverse=True)
    far = int(b.max()) + 1
    reach = np.maximum.accumulate(b + group * far) - group * far
    new[1:] = (owner[1:] != owner[:-1]) | (a[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return owner[first], a[first], np.maximum.reduceat(b, first)


_RUN = "anchor long, context long, k1 long, k2 int, place long"
_FOUND = "k1 long, k2 int, a int, b int, anchor long, needs boolean"


def _pack(lo, hi, many):
    return lo << 12 | (hi - lo) << 1 | many


def _scan(length: int, q: int):
    """Rows of runs to meet by anchor (``place`` packs starts and whether equal contexts were
    settled here), rows of settled intervals (null anchor; ``context`` holds the end), and rows of
    anchors with many runs among those settled together (null key; ``context`` holds the runs)."""

    def rows(anchor, context, k1, k2, place, gap=False, keyless=False):
        return pa.RecordBatch.from_arrays(
            [
                pa.array(anchor, pa.int64(), mask=np.full(len(anchor), gap)), pa.array(context, pa.int64()),
                pa.array(k1, pa.int64(), mask=np.full(len(anchor), keyless)), pa.array(k2, pa.int32()), pa.array(place, pa.int64()),
            ],
            names=["anchor", "context", "k1", "k2", "place"],
        )

    def settle(held):
        text, lo, hi, anchor, context = (np.concatenate(x) for x in zip(*[h[:5] for h in held], strict=True))
        k1, k2 = (np.concatenate([h[i] for h in held]) for i in (5, 6))
        order = np.lexsort((context, anchor))
        text, lo, hi, anchor, context, k1, k2 = (x[order] for x in (text, lo, hi, anchor, context, k1, k2))
        head = np.ones(len(anchor), bool)
        head[1:] = (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])
        count = np.diff(np.append(np.flatnonzero(head), len(anchor)))
        many = np.repeat(count > 1, count)
        yield from pieces(rows(anchor[head], context[head], k1[head], k2[head], _pack(lo[head], hi[head], many[head].astype("i8"))))
        anchors, sent = np.unique(anchor[head], return_counts=True)
        often = (sent > 1) & (sent * HEAVY >= len(count))
        if often.any():
            none = np.zeros(int(often.sum()), "i8")
            yield from pieces(rows(anchors[often], sent[often], none, none.astype("i4"), none, keyless=True))
        if many.any():
            owner, a, b = _merged(text[many], lo[many], hi[many] + length)
            first = dict(zip(text.tolist(), range(len(text)), strict=True))
            at = np.array([first[t] for t in owner.tolist()])
            yield from pieces(rows(np.zeros(len(a), "i8"), b, k1[at], k2[at], a, gap=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, n, base = [], 0, 0
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                raw, off = utf8(part.column("text"))
                k1, k2 = part.column("k1").to_numpy(), part.column("k2").to_numpy()
                for own, poff, first, place in _pieces(raw, off, length):
                    text, lo, hi, anchor, context = runs(own, poff, length, q)
                    text = text + first
                    held.append((text + base, lo + place, hi + place, anchor, context, k1[text], k2[text]))
                    n += len(lo)
                base += part.num_rows
                if n >= SETTLE_RUNS:
                    yield from settle(held)
                    held, n = [], 0
        if n:
            yield from settle(held)

    return run


def _meet(length: int):
    """Runs in the order of (anchor, context): intervals of equal contexts, and the runs of anchors
    with different contexts (one of each repeated context, which needs no answer).  A heavy anchor
    may have contexts in other tasks, so all of its contexts count as edges.  The rows of a batch's
    last context are carried to the next batch, all but two of a long context are passed on before."""

    def out(cols, anchors, needs):
        anchor, _, k1, k2, place, _ = cols
        lo = place >> 12
        return pa.RecordBatch.from_arrays(
            [
                pa.array(k1, pa.int64()), pa.array(k2, pa.int32()), pa.array(lo, pa.int32()), pa.array(lo + (place >> 1 & 0x7FF) + length, pa.int32()),
                pa.array(anchor, pa.int64(), mask=np.full(len(lo), not anchors)), pa.array(needs),
            ],
            names=["k1", "k2", "a", "b", "anchor", "needs"],
        )

    def full(cols, pick):
        if pick.any():
            yield out([c[pick] for c in cols], False, np.zeros(int(pick.sum()), bool))

    def decide(cols, before, after):
        """Whole contexts; the first anchor has had contexts ``before``, the last has some ``after``."""
        anchor, context, _, _, place, heavy = cols
        many = place & 1
        new_a = np.ones(len(anchor), bool)
        new_a[1:] = anchor[1:] != anchor[:-1]
        new_c = new_a.copy()
        new_c[1:] |= context[1:] != context[:-1]
        c_id, a_id = np.cumsum(new_c) - 1, np.cumsum(new_a) - 1
        repeated = np.bincount(c_id) + np.bincount(c_id, weights=many) > 1
        contexts = np.bincount(a_id[new_c])
        contexts[0] += before
        contexts[-1] += after
        yield from full(cols, repeated[c_id] & (many == 0))
        edge = ((contexts[a_id] > 1) | heavy) & (~repeated[c_id] | new_c)
        if edge.any():
            yield out([c[edge] for c in cols], True, ~repeated[c_id[edge]])

    def run(batches):
        rest, before = None, False
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            anchor, context = cols[:2]
            if not len(anchor):
                continue
            cut = int(np.argmax((anchor == anchor[-1]) & (context == context[-1])))
            rest = [c[cut:] for c in cols]
            if cut:
                after = bool(anchor[cut - 1] == anchor[cut])
                yield from decide([c[:cut] for c in cols], before, after)
                before = after
            if len(rest[0]) > KEPT_RUNS:
                tail = [c[2:] for c in rest]
                yield from full(tail, tail[4] & 1 == 0)
                rest = [c[:2] for c in rest]
        if rest is not None:
            yield from decide(rest, before, False)

    return run


def refine(raw: np.ndarray, off: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether each byte place starts ``length`` bytes, inside its string, that start elsewhere too.

    Bucket-pointer refinement: places are put into buckets by their first 64 bytes; buckets are split
    by the bucket at a later offset, first of the 64-gram buckets and then of the buckets that this
    has made.  Lone places leave at once.  The last offset makes the compared bytes exactly ``length``.
    """
    n = len(raw)
    left = np.repeat(off[1:], np.diff(off)) - np.arange(n)  # bytes to the end of the string
    out = np.zeros(n, bool)
    depth = min(64, length)
    at = np.flatnonzero(left >= depth)
    if not len(at):
        return out
    bucket = np.full(n, -1, "i8")
    _, ids, counts = np.unique(Rolling(raw).grams(depth)[at], return_inverse=True, return_counts=True)
    while True:
        bucket[:] = -1
        crowd = counts[ids] > 1
        bucket[at[crowd]] = ids[crowd]
        if depth == length:
            out[at[crowd]] = True
            return out
        more = min(depth, length - depth)
        at = at[crowd]
        at = at[left[at] >= depth + more]
        at = at[bucket[at + more] >= 0]
        if not len(at):
            return out
        pair = bucket[at] * n + bucket[at + more]
        _, ids, counts = np.unique(pair, return_inverse=True, return_counts=True)
        depth += more


def _interval_rows(k1, k2, start, length):
    _, a, b = _merged(np.zeros(len(start), "i8"), start, start + length)
    return [(k1, k2, int(x), int(y)) for x, y in zip(a, b, strict=True)]


def _starts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], "<i8")[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], "u1")[off[0] : off[-1]], off - off[0]


def _refined(length: int):
    """Contexts in the order of anchors -> intervals of repeated windows, whole anchors at a time."""

    def answer(batch: pa.RecordBatch):
        raw, off = _starts(batch.column("bytes"))
        found = np.flatnonzero(refine(raw, off, length))
        row = np.searchsorted(off, found, "right") - 1
        needs = np.asarray(batch.column("needs"))
        keep = needs[row]
        found, row = found[keep], row[keep]
        start = batch.column("a").to_numpy()[row] + found - off[row]
        owner, a, b = _merged(row, start, start + length)
        return pa.RecordBatch.from_arrays(
            [batch.column("k1").take(pa.array(owner)), batch.column("k2").take(pa.array(owner)), pa.array(a, pa.int32()), pa.array(b, pa.int32())],
            names=["k1", "k2", "a", "b"],
        )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("bytes").nbytes
            if size < REFINE_BYTES:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            anchor = table.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1], "left"))
            done, rest = table.slice(0, cut), table.slice(cut)
            for part in _by_anchor(done):
                yield answer(part)
            held = rest.combine_chunks().to_batches()
            size = rest.column("bytes").nbytes if rest.num_rows else 0
        if held:
            for part in _by_anchor(pa.Table.from_batches(held).combine_chunks()):
                yield answer(part)

    return run


def _by_anchor(table: pa.Table):
    """Parts of about ``REFINE_BYTES`` that keep an anchor's rows together."""
    anchor = table.column("anchor").to_numpy()
    size = np.cumsum(pc.binary_length(table.column("bytes")).to_numpy())
    a = 0
    while a < len(anchor):
        b = int(np.searchsorted(size, (size[a - 1] if a else 0) + REFINE_BYTES, "right"))
        b = int(np.searchsorted(anchor, anchor[min(max(b, a + 1), len(anchor)) - 1], "right"))
        yield table.slice(a, b - a).combine_chunks().to_batches()[0]
        a = b


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH, q: int = Q) -> DataFrame:
    """``docs`` has ``text``, ``k1`` and ``k2`` (the key of equal texts).  Per key the list ``spans``
    of byte intervals that repeated windows cover; keys without any are left out."""
    runs_ = scratch.save(docs.select("text", "k1", "k2").mapInArrow(_scan(length, q), _RUN), "runs")
    settled = runs_.filter("anchor is null").select("k1", "k2", F.col("place").cast("int").alias("a"), F.col("context").cast("int").alias("b"))
    runs_of = runs_.filter("anchor is not null and k1 is not null")
    # The counts of an anchor add up to no more than all runs, so at most HEAVY anchors are broadcast.
    heavy = runs_.filter("anchor is not null and k1 is null").groupBy("anchor").agg(F.sum("context").alias("n"))
    heavy = heavy.filter(F.col("n") * HEAVY >= runs_of.count()).select("anchor", F.lit(True).alias("heavy"))
    dealt = runs_of.join(F.broadcast(heavy), "anchor", "left").select(*runs_of.columns, F.coalesce("heavy", F.lit(False)).alias("heavy"))
    dealt = dealt.repartition("anchor", F.when(F.col("heavy"), F.col("context"))).sortWithinPartitions("anchor", "context")
    met = scratch.save(dealt.mapInArrow(_meet(length), _FOUND), "met")
    equal = met.filter("anchor is null").select("k1", "k2", "a", "b")
    edges = met.filter("anchor is not null")
    per_anchor = edges.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_CONTEXTS).select("anchor", F.lit(True).alias("hot"))
    per_anchor = scratch.save(per_anchor, "hot")
    flagged = edges.join(F.broadcast(per_anchor) if per_anchor.count() <= BROADCAST_ROWS else per_anchor, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = flagged.groupBy("k1", "k2").agg(F.collect_set(F.struct("anchor", "a", "b", "needs", "hot")).alias("wanted"))

    def cut(batches):
        """The contexts' bytes."""
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                raw, off = utf8(part.column("text"))
                w = part.column("wanted")
                rows, item = np.repeat(np.arange(part.num_rows), np.diff(w.offsets.to_numpy())), w.flatten()
                a, b = item.field("a").to_numpy(), item.field("b").to_numpy()
                data = raw.tobytes()
                base = off[rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("k1").take(pa.array(rows)), part.column("k2").take(pa.array(rows)), item.field("a"), item.field("anchor"),
                        item.field("needs"), item.field("hot"),
                        pa.array([data[s + x : s + y] for s, x, y in zip(base.tolist(), a.tolist(), b.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["k1", "k2", "a", "anchor", "needs", "hot", "bytes"],
                )

    one_each = docs.select("text", "k1", "k2").join(wanted, ["k1", "k2"])
    contexts = scratch.save(one_each.mapInArrow(cut, "k1 long, k2 int, a int, anchor long, needs boolean, hot boolean, bytes binary"), "contexts")
    gc.collect()
    docs.sparkSession.sparkContext._jvm.System.gc()
    cool = contexts.filter("not hot").select("anchor", "k1", "k2", "a", "needs", "bytes").dropDuplicates(["anchor", "k1", "k2", "a"])
    refined = cool.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_refined(length), "k1 long, k2 int, a int, b int")
    # A hot anchor's windows one by one: equal windows of a task meet before the shuffle.
    windows = contexts.filter("hot").select(
        "k1", "k2", "a", "needs", "bytes", F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - length)).alias("i")
    ).withColumn("window", F.md5(F.substring(F.col("bytes"), F.col("i") + 1, F.lit(length)))).drop("bytes")
    places = windows.select("window", "k1", "k2", (F.col("a") + F.col("i")).alias("a"), "needs")
    twice = places.groupBy("window").agg(
        F.min(F.struct("k1", "k2", "a")).alias("first"), F.max(F.struct("k1", "k2", "a")).alias("last")
    ).filter("first <> last").select("window")
    hot = places.filter("needs").join(twice, "window").select("k1", "k2", "a", (F.col("a") + length).alias("b"))
    every = settled.unionByName(equal).unionByName(refined).unionByName(hot)
    return every.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def _covered(n: int, spans: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """United intervals."""
    v = spans.values
    if v is None or not len(v):
        return np.empty(0, "i8"), np.empty(0, "i8")
    a, b = v.field("a").to_numpy().astype("i8"), v.field("b").to_numpy().astype("i8")
    _, a, b = _merged(np.zeros(len(a), "i8"), a, b)
    return a, b


def remove_repeats(docs: DataFrame, length: int = LENGTH, q: int = Q, with_text: bool = False) -> DataFrame:
    """``docs`` (with ``text``; a row's other columns stay) with ``n_bytes``, ``n_removed``,
    ``n_spans``, ``kept_sha256`` and, if asked for, ``kept_text`` added.

    Texts are UTF-8 bytes (null: empty).  A byte goes when a string of ``length`` bytes covers it that
    also starts anywhere else in the table, the same text included, so of two equal texts of ``length``
    bytes or more nothing is left.  In ``kept_text`` bytes that a cut leaves of a broken character are dropped.  Columns of ``docs``
    with an added name are replaced.  Repeated rows are each other's copies, and none is spared, so ties
    don't arise.  A very long text is cut into overlapping pieces and compared with itself as with all
    others.  An empty table gives an empty result.
    """
    if not q <= length < q + 2048:
        raise ValueError(f"strings of {q} to {q + 2047} bytes, not {length}: a run's width has eleven bits")
    scratch = Scratch(docs.sparkSession, "repeats")
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if with_text else [])]
    own = [c for c in docs.columns if c not in {*added, "k1", "k2", "spans", "_whole"}]
    keyed = docs.select(*own, text_or_empty().alias("_whole")).withColumn("k1", F.xxhash64("_whole")).withColumn("k2", F.hash("_whole"))
    spans = scratch.save(repeated_spans(keyed.select(F.col("_whole").alias("text"), "k1", "k2").filter(F.octet_length("text") >= length), scratch, length, q), "spans")
    gc.collect()
    docs.sparkSession.sparkContext._jvm.System.gc()
    joined = keyed.join(spans, ["k1", "k2"], "left").drop("k1", "k2")
    if "text" in own and not with_text:
        joined = joined.drop("text")
        own = [c for c in own if c != "text"]
    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name in own] + ["n_bytes long, n_removed long, n_spans long, kept_sha256 string"] + ["kept_text string"] * with_text)

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "_whole", STEP_BYTES):
                out = {c: part.column(c) for c in own}
                size, gone, count, digest, rest = [], [], [], [], []
                for text, span in zip(part.column("_whole").to_pylist(), part.column("spans"), strict=True):
                    data = text.encode()
                    a, b = _covered(len(data), span)
                    keep, at = [], 0
                    for x, y in zip(a.tolist(), b.tolist(), strict=True):
                        keep.append(data[at:x])
                        at = y
                    keep.append(data[at:])
                    left = b"".join(keep)
                    size.append(len(data))
                    gone.append(len(data) - len(left))
                    count.append(len(a))
                    digest.append(hashlib.sha256(left).hexdigest())
                    if with_text:
                        rest.append(left.decode("utf-8", "ignore"))
                out |= {"n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(count, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
                if with_text:
                    out["kept_text"] = pa.array(rest, pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return joined.mapInArrow(cut, types)
