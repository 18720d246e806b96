"""Gradient-boosted trees on histograms: leaf by leaf, of any number of models at once.

Rows are put into bins once and packed into blocks, one per partition.  A pass over the blocks sums up
gradients, hessians and rows by (feature, node, bin); the sums meet by (feature, node) in a shuffle,
where the best split of each is found; only splits reach the driver, one for each node and reducer.

Trees grow best first: of all leaves the one with the largest gain is split next.  A pass takes up all
leaves that this order reaches with the splits known so far, so a tree needs about as many passes as it
is deep, not one for each split, and gets the same leaves.  Models (a value of ``by`` each) grow side by
side in the same passes.

Absolute-error trees take the medians of their leaves' residuals, found by counts of ordered bits: the
counts of bins first, then of the values in the bins with the middle ranks.  The others take one Newton
step.  Sums are added up in the order of the blocks, so a rerun over the same blocks gives the same trees.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import clip
from ..sources.tables import checkpointed, on_executors
from .features import _bin
from .guards import GuardError, check_no_target


@dataclass(frozen=True)
class BoostConfig:
    """The defaults are those of the full model.

    ``objective``: absolute, poisson or tweedie (of ``power``).  ``bins`` counts the one for nulls.
    Categories are tried in the order of their smoothed gradients, at most ``most_categories`` on the left."""

    objective: str = "absolute"
    power: float = 1.1
    rounds: int = 300
    rate: float = 0.05
    leaves: int = 31
    least_rows: int = 100
    least_hessian: float = 1e-3
    bins: int = 255
    ridge: float = 0.0
    most_categories: int = 32
    category_smooth: float = 10.0
    category_ridge: float = 10.0
    #: Rows of a block, and rounds after which the blocks' lineage is cut.
    block_rows: int = 1 << 20
    cut_rounds: int = 10


@dataclass
class Tree:
    """Nodes by number, the root is 0.  Left are bins up to ``bin``, or the codes in ``codes``; a leaf has no ``left``."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    codes: list[np.ndarray | None] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def leaves(self) -> list[int]:
        return [i for i, a in enumerate(self.left) if a < 0]


@dataclass
class Boosted:
    """Trees of each model by round; a model without a split to make has none from there on."""

    config: BoostConfig
    columns: list[str]
    categorical: list[str]
    edges: list[np.ndarray | None]
    by: str | None
    start: dict[int, float]
    trees: dict[int, list[Tree]]

    def threshold(self, tree: Tree, node: int) -> float:
        """The largest value on the left of a split of numbers."""
        return float(self.edges[tree.feature[node]][tree.bin[node]])

    def categories(self, tree: Tree, node: int) -> list[int]:
        """The categories on the left of a split of categories."""
        return (tree.codes[node] - 1).tolist()


# --- bins


def bin_edges(train: DataFrame, columns: list[str], bins: int) -> tuple[dict[str, np.ndarray], int]:
    """For each column the upper edges of all bins but the last, and the number of rows.

    Values are counted by a step function with some ten thousand steps; steps are joined to bins of about
    equal counts, a step that fills a bin gets one of its own.  Edges are half way between the values beside them."""
    most = bins - 1
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)])).alias("_")
    x = F.col("_.x")
    known = train.select(each).select("_.f", x.alias("x")).withColumn("step", F.when(~F.isnan("x"), _bin(F.col("x"))))
    counted = known.groupBy("f", "step").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    got = counted.toArrow()  # steps of each column
    f, step, n = (got.column(c).to_numpy() for c in ("f", "step", "n"))
    low, high = got.column("low").to_numpy(), got.column("high").to_numpy()
    out, rows = {}, 0
    for i, c in enumerate(columns):
        rows = int(n[f == i].sum()) if (f == i).any() else 0
        m = (f == i) & ~np.isnan(step.astype(float))
        order = np.argsort(low[m], kind="stable")
        counts, lows, highs = n[m][order], low[m][order], high[m][order]
        closed = _closed(counts, most)
        out[c] = (highs[closed] + lows[closed + 1]) / 2
    return out, rows


def _closed(counts: np.ndarray, most: int) -> np.ndarray:
    """The last step of each bin but the last one."""
    if len(counts) <= most:
        return np.arange(max(len(counts) - 1, 0))
    left, bins, held, out = int(counts.sum()), most, 0, []
    for i, c in enumerate(counts[:-1].tolist()):
        if held and bins > 2 and held + c > 1.5 * left / bins:
            out.append(i - 1)
            left, bins, held = left - held, bins - 1, 0
        held += c
        if held >= left / bins and len(out) < most - 1:
            out.append(i)
            left, bins, held = left - held, bins - 1, 0
    return np.array(sorted(set(out)), dtype=np.int64)


def to_bins(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """0 up to the number of edges; nulls are one beyond, above all values."""
    return np.where(np.isnan(x), len(edges) + 1, np.searchsorted(edges, x, side="left"))


@dataclass(frozen=True)
class Layout:
    """How a block holds its rows: bins of columns of numbers as bytes, codes of categories (0: null) as 32 bits."""

    columns: tuple[str, ...]
    edges: tuple[np.ndarray | None, ...]
    models: tuple[int, ...]
    target: str
    by: str | None

    @property
    def numbers(self) -> list[int]:
        return [i for i, e in enumerate(self.edges) if e is not None]

    def matrix(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        """Bins or codes of each column."""
        out = []
        for c, e in zip(self.columns, self.edges, strict=True):
            x = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.float64)
            out.append(to_bins(x, e).astype(np.uint8) if e is not None else np.where(np.isnan(x), 0, x + 1).astype(np.int32))
        return out


_BLOCK = T.StructType(
    [T.StructField("part", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("sizes", "bins", "codes", "y", "score")]]
)
_BLOCK_ARROW = pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in ("sizes", "bins", "codes", "y", "score")]])


@dataclass
class Block:
    part: int
    sizes: np.ndarray
    matrix: list[np.ndarray]
    y: np.ndarray
    score: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)])


def _pack(layout: Layout, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    parts, ys, ms = [], [], []
    place = {m: i for i, m in enumerate(layout.models)}
    for batch in batches:
        if batch.num_rows:
            parts.append(layout.matrix(batch))
            ys.append(batch.column(batch.schema.get_field_index("_y")).to_numpy(zero_copy_only=False).astype(np.float64))
            of = batch.column(batch.schema.get_field_index("_m")).to_pylist()
            ms.append(np.array([place[m] for m in of]))
    if not ys:
        return
    y = np.concatenate(ys)
    if not np.isfinite(y).all():
        raise ValueError("a training row without a finite target")
    model = np.concatenate(ms)
    order = np.argsort(model, kind="stable")
    columns = [np.concatenate([p[i] for p in parts])[order] for i in range(len(layout.columns))]
    numbers = set(layout.numbers)
    yield _block(
        TaskContext.get().partitionId(), np.bincount(model, minlength=len(layout.models)), b"".join(x.tobytes() for i, x in enumerate(columns) if i in numbers),
        b"".join(x.tobytes() for i, x in enumerate(columns) if i not in numbers), y[order], np.zeros(len(y)),
    )


def _block(part: int, sizes: np.ndarray, bins: bytes, codes: bytes, y: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    values = [part, sizes.astype(np.int64).tobytes(), bins, codes, y.tobytes(), score.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCK_ARROW, strict=True)], schema=_BLOCK_ARROW)


def _blocks(layout: Layout, batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    numbers = layout.numbers
    place = {f: i for i, f in enumerate(numbers)}
    others = {f: i for i, f in enumerate(f for f in range(len(layout.columns)) if f not in place)}
    for batch in batches:
        for r in range(batch.num_rows):
            raw = {f.name: batch.column(i)[r] for i, f in enumerate(batch.schema)}
            y = np.frombuffer(raw["y"].as_buffer(), np.float64)
            bins = np.frombuffer(raw["bins"].as_buffer(), np.uint8).reshape(len(numbers), len(y))
            codes = np.frombuffer(raw["codes"].as_buffer(), np.int32).reshape(len(others), len(y))
            matrix = [bins[place[f]] if f in place else codes[others[f]] for f in range(len(layout.columns))]
            yield Block(raw["part"].as_py(), np.frombuffer(raw["sizes"].as_buffer(), np.int64), matrix, y, np.frombuffer(raw["score"].as_buffer(), np.float64))


# --- objectives


def slopes(config: BoostConfig, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of each row's loss."""
    if config.objective == "absolute":
        return np.sign(score - y), np.ones(len(y))
    if config.objective == "poisson":
        return np.exp(score) - y, np.exp(score + 0.7)  # the hessian is made larger, for short steps
    a, b = 1 - config.power, 2 - config.power
    one, two = y * np.exp(a * score), np.exp(b * score)
    return two - one, b * two - a * one


def deviance(config: BoostConfig, y: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Each row's loss."""
    if config.objective == "absolute":
        return np.abs(y - score)
    if config.objective == "poisson":
        return np.exp(score) - y * score
    a, b = 1 - config.power, 2 - config.power
    return np.exp(b * score) / b - y * np.exp(a * score) / a


# --- splits


def goes_left(tree: Tree, node: int, x: np.ndarray) -> np.ndarray:
    codes = tree.codes[node]
    return x <= tree.bin[node] if codes is None else np.isin(x, codes)


def route(tree: Tree, matrix: list[np.ndarray], rows: np.ndarray) -> dict[int, np.ndarray]:
    """The rows of each leaf."""
    at, out = {0: rows}, {}
    for node in range(len(tree.left)):
        mine = at.pop(node)
        if tree.left[node] < 0:
            out[node] = mine
            continue
        left = goes_left(tree, node, matrix[tree.feature[node]][mine])
        at[tree.left[node]], at[tree.right[node]] = mine[left], mine[~left]
    return out


_SUMS = "feature int, node long, part int, payload binary"
_SUMS_ARROW = pa.schema([("feature", pa.int32()), ("node", pa.int64()), ("part", pa.int32()), ("payload", pa.binary())])
_SPLIT = "node long, feature int, bin int, codes binary, gain double, g double, h double, n double, left_g double, left_h double, left_n double"
_SPLIT_ARROW = pa.schema(
    [("node", pa.int64()), ("feature", pa.int32()), ("bin", pa.int32()), ("codes", pa.binary()), *[(c, pa.float64()) for c in ("gain", "g", "h", "n", "left_g", "left_h", "left_n")]]
)
#: Bytes of sums that a task adds up, at about; those of a leaf's counts.
REDUCED_BYTES, COUNT_BYTES = 16_000_000, 16_000
#: A node's number: the model's times this, and its own.
NODES = 1 << 20


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SUMS_ARROW)], schema=_SUMS_ARROW)


def _histograms(layout: Layout, config: BoostConfig, growing: dict[int, tuple[Tree, list[int]]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by feature, node and bin of one block; of categories only those that are there."""
    for b in _blocks(layout, batches):
        g, h = slopes(config, b.y, b.score)
        nodes, held = [], []
        for m, (tree, active) in growing.items():
            found = route(tree, b.matrix, np.arange(b.first[m], b.first[m + 1]))
            for node in active:
                if len(found[node]):
                    nodes.append(m * NODES + node)
                    held.append(found[node])
        if not nodes:
            continue
        rows = np.concatenate(held)
        local = np.repeat(np.arange(len(nodes)), [len(x) for x in held])
        gr, hr = g[rows], h[rows]
        plain = config.objective == "absolute"
        out = []
        for f, e in enumerate(layout.edges):
            x = b.matrix[f][rows].astype(np.int64)
            if e is not None:
                width = len(e) + 2
                key, size = local * width + x, len(nodes) * width
                n = np.bincount(key, minlength=size).astype(np.float64)
                sums = np.stack([np.bincount(key, gr, size), n if plain else np.bincount(key, hr, size), n]).reshape(3, len(nodes), width)
                out += [(f, nodes[k], b.part, sums[:, k].tobytes()) for k in range(len(nodes))]
            else:
                width = int(x.max()) + 1
                seen, key = np.unique(local * width + x, return_inverse=True)
                n = np.bincount(key).astype(np.float64)
                sums = np.stack([(seen % width).astype(np.float64), np.bincount(key, gr), n if plain else np.bincount(key, hr), n])
                edges = np.searchsorted(seen, np.arange(len(nodes) + 1) * width)
                out += [(f, nodes[k], b.part, sums[:, edges[k] : edges[k + 1]].tobytes()) for k in range(len(nodes))]
        yield _emit(out)


def _score(g, h, ridge: float):
    return g * g / (h + ridge)


def _allowed(config: BoostConfig, h: np.ndarray, n: np.ndarray, total_h: float, total_n: float) -> np.ndarray:
    return (n >= config.least_rows) & (total_n - n >= config.least_rows) & (h >= config.least_hessian) & (total_h - h >= config.least_hessian)


def best_of_numbers(config: BoostConfig, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple | None:
    """(gain, bin, None, left sums): the first of the best thresholds."""
    left = np.cumsum(np.stack([g, h, n]), axis=1)[:, :-1]
    total = g.sum(), h.sum(), n.sum()
    ok = _allowed(config, left[1], left[2], total[1], total[2])
    if not ok.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = _score(left[0], left[1], config.ridge) + _score(total[0] - left[0], total[1] - left[1], config.ridge) - _score(total[0], total[1], config.ridge)
    gain = np.where(ok, gain, -np.inf)
    i = int(np.argmax(gain))
    return (float(gain[i]), i, None, tuple(left[:, i].tolist())) if gain[i] > 1e-12 else None


def best_of_categories(config: BoostConfig, codes: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple | None:
    """(gain, -1, codes on the left, left sums): prefixes of the categories by gradient, from either end.

    Nulls (code 0) and categories with fewer rows than the smoothing stay on the right."""
    total = g.sum(), h.sum(), n.sum()
    use = np.flatnonzero((codes > 0) & (n >= config.category_smooth))
    if not len(use):
        return None
    order = use[np.argsort(g[use] / (h[use] + config.category_smooth), kind="stable")]
    best = None
    for way in (order, order[::-1]):
        way = way[: config.most_categories]
        left = np.cumsum(np.stack([g[way], h[way], n[way]]), axis=1)
        ok = _allowed(config, left[1], left[2], total[1], total[2])
        if not ok.any():
            continue
        ridge = config.ridge + config.category_ridge
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = _score(left[0], left[1], ridge) + _score(total[0] - left[0], total[1] - left[1], ridge) - _score(total[0], total[1], config.ridge)
        gain = np.where(ok, gain, -np.inf)
        i = int(np.argmax(gain))
        if gain[i] > 1e-12 and (best is None or gain[i] > best[0]):
            best = float(gain[i]), -1, np.sort(codes[way[: i + 1]]), tuple(left[:, i].tolist())
    return best


def _best_splits(layout: Layout, config: BoostConfig, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best split of each node over this task's features; sums arrive by feature, node and block."""
    best: dict[int, tuple] = {}
    key, held = None, []

    def close() -> None:
        if key is None:
            return
        f, node = key
        if layout.edges[f] is not None:
            sums = held[0].reshape(3, -1).copy()
            for x in held[1:]:
                sums += x.reshape(3, -1)
            found = best_of_numbers(config, *sums)
            total = sums.sum(axis=1)
        else:
            all_ = np.concatenate([x.reshape(4, -1) for x in held], axis=1)
            codes, at = np.unique(all_[0].astype(np.int64), return_inverse=True)
            sums = np.stack([np.bincount(at, w) for w in all_[1:]])
            found = best_of_categories(config, codes, *sums)
            total = sums.sum(axis=1)
        if found is not None and (node not in best or (-found[0], f) < (-best[node][4], best[node][1])):
            best[node] = (node, f, found[1], None if found[2] is None else found[2].astype(np.int64).tobytes(), found[0], *total.tolist(), *found[3])

    for batch in batches:
        for f, node, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
            if (f, node) != key:
                close()
                key, held = (f, node), []
            held.append(np.frombuffer(payload.as_buffer(), np.float64))
    close()
    rows = list(best.values())
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SPLIT_ARROW)], schema=_SPLIT_ARROW)


# --- growth


class Growing:
    """A tree on the way: nodes with the best splits that are known of them."""

    def __init__(self, config: BoostConfig):
        self.config = config
        self.split: list[tuple | None] = [None]
        self.known = [False]
        self.children: list[tuple[int, int] | None] = [None]
        self.sums: list[tuple[float, float, float] | None] = [None]

    def learn(self, node: int, split: tuple | None) -> None:
        """``split``: (gain, feature, bin, codes, all sums, left sums), or None where there is none."""
        self.split[node], self.known[node] = split, True
        if split is not None:
            self.sums[node] = split[4]

    def _add(self, sums: tuple) -> int:
        small = sums[2] < 2 * self.config.least_rows
        self.split.append(None)
        self.known.append(small)
        self.children.append(None)
        self.sums.append(sums)
        return len(self.known) - 1

    def order(self) -> list[int]:
        """The nodes that are split, best first, as far as splits are known."""
        heap, out = [], []

        def push(node: int) -> None:
            if self.known[node] and self.split[node] is not None:
                heapq.heappush(heap, (-self.split[node][0], node))

        push(0)
        while heap and len(out) < self.config.leaves - 1:
            _, node = heapq.heappop(heap)
            out.append(node)
            for child in self.children[node] or ():
                push(child)
        return out

    def wanted(self) -> list[int]:
        """Nodes whose splits may change the order and aren't known; empty once the tree is grown."""
        if not self.known[0]:
            return [0]
        order = self.order()
        for node in order:
            if self.children[node] is None:
                _, _, _, _, all_, left = self.split[node]
                self.children[node] = self._add(left), self._add(tuple(a - b for a, b in zip(all_, left, strict=True)))
        may = order[: self.config.leaves - 2]  # the last split's children stay leaves
        return [c for node in may for c in self.children[node] if not self.known[c]]

    def tree(self, kept: list[int] | None = None) -> tuple[Tree, dict[int, int]]:
        """The tree of the nodes ``kept`` (all that have children), and where each node is in it; parents come first."""
        inner = set(kept) if kept is not None else {i for i, c in enumerate(self.children) if c}
        tree, at, stack = Tree(), {}, [0]
        while stack:
            node = stack.pop()
            at[node] = len(tree.left)
            split = self.split[node] if node in inner else None
            tree.feature.append(split[1] if split else -1)
            tree.bin.append(split[2] if split else -1)
            tree.codes.append(split[3] if split else None)
            tree.gain.append(split[0] if split else 0.0)
            tree.left.append(-1)
            tree.right.append(-1)
            tree.value.append(0.0)
            if split:
                stack += [self.children[node][1], self.children[node][0]]
        for node in inner & at.keys():
            tree.left[at[node]], tree.right[at[node]] = (at[c] for c in self.children[node])
        return tree, at


# --- medians of leaves


_COUNTS = "node long, part int, payload binary"
_COUNTS_ARROW = pa.schema([("node", pa.int64()), ("part", pa.int32()), ("payload", pa.binary())])
_MIDDLE = "node long, low long, low_before long, high long, high_before long, n long"
_MIDDLE_ARROW = pa.schema([(c, pa.int64()) for c in ("node", "low", "low_before", "high", "high_before", "n")])
#: Bits of a residual that its bin leaves out.
INNER_BITS = 44


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values."""
    bits = (x + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def from_bits(bits: int) -> float:
    x = np.array([bits], np.int64)
    return float((x ^ ((x >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)[0])


def _counts(layout: Layout, trees: dict[int, Tree], wanted: dict[int, tuple] | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By leaf the residuals' bins and their rows, or the values in the ``wanted`` bins."""
    for b in _blocks(layout, batches):
        out = []
        for m, tree in trees.items():
            for leaf, rows in route(tree, b.matrix, np.arange(b.first[m], b.first[m + 1])).items():
                bits = ordered_bits(b.y[rows] - b.score[rows])
                if wanted is not None:
                    low, _, high, _, _ = wanted[m * NODES + leaf]
                    bits = bits[(bits >> INNER_BITS == low) | (bits >> INNER_BITS == high)]
                else:
                    bits = bits >> INNER_BITS
                if len(bits):
                    values, n = np.unique(bits, return_counts=True)
                    out.append((m * NODES + leaf, b.part, np.stack([values, n]).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_COUNTS_ARROW)], schema=_COUNTS_ARROW)


def _middle(wanted: dict[int, tuple] | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of counted values of each leaf the two of the middle ranks."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for node, payload in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            held.setdefault(node, []).append(np.frombuffer(payload.as_buffer(), np.int64).reshape(2, -1))
    out = []
    for node, parts in held.items():
        all_ = np.concatenate(parts, axis=1)
        values, at = np.unique(all_[0], return_inverse=True)
        upto = np.cumsum(np.bincount(at, all_[1]).astype(np.int64))
        if wanted is None:
            n = int(upto[-1])
            i, j = np.searchsorted(upto, [(n + 1) // 2, (n + 2) // 2])
            before = np.concatenate([[0], upto])
            out.append((node, int(values[i]), int(before[i]), int(values[j]), int(before[j]), n))
        else:
            low, low_before, high, high_before, n = wanted[node]
            # values of the higher bin come after all of the lower one's
            skipped = 0 if low == high else int(upto[np.searchsorted(values >> INNER_BITS, high) - 1])
            i = np.searchsorted(upto, (n + 1) // 2 - low_before)
            j = np.searchsorted(upto, (n + 2) // 2 - high_before + skipped)
            out.append((node, int(values[i]), 0, int(values[j]), 0, n))
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_MIDDLE_ARROW)], schema=_MIDDLE_ARROW)


def leaf_medians(blocks: DataFrame, layout: Layout, trees: dict[int, Tree], parts: int) -> dict[int, float]:
    """The median residual of each leaf (model times ``NODES`` and leaf), exactly, in two passes of counts."""
    wanted = None
    for _ in range(2):
        counts = blocks.mapInArrow(partial(_counts, layout, trees, wanted), _COUNTS).repartition(parts, "node")
        found = counts.mapInArrow(partial(_middle, wanted), _MIDDLE).collect()  # a row per leaf
        wanted = {r["node"]: tuple(r)[1:] for r in found}
    return {node: (from_bits(w[0]) + from_bits(w[2])) / 2 for node, w in wanted.items()}


def _advanced(layout: Layout, steps: dict[int, Tree] | dict[int, float], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their scores moved by a tree, or a number, for each model."""
    for batch in batches:
        for r, b in enumerate(_blocks(layout, [batch])):
            score = b.score.copy()
            for m, step in steps.items():
                rows = np.arange(b.first[m], b.first[m + 1])
                if isinstance(step, Tree):
                    for leaf, mine in route(step, b.matrix, rows).items():
                        score[mine] += step.value[leaf]
                else:
                    score[rows] += step
            raw = [batch.column(i)[r].as_py() for i in range(len(batch.schema) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([*raw, score.tobytes()], _BLOCK_ARROW, strict=True)], schema=_BLOCK_ARROW)


# --- training and prediction


def fit_boosted(
    train: DataFrame, config: BoostConfig, columns: Iterable[str], target: str = "sales", categorical: Iterable[str] = (), by: str | None = None
) -> Boosted:
    """Boosted trees; with ``by`` one model for each of its values (whole numbers), all in the same passes.

    ``categorical`` columns hold whole numbers from 0 on.  A null number is above all others, a null
    category goes right, a null target is an error.  For poisson and tweedie a negative target counts as 0."""
    columns, categorical = list(columns), [c for c in categorical if c in set(columns)]
    check_no_target(train.select(*columns), target)
    spark = train.sparkSession
    on_executors(spark)
    y = F.col(target).cast("double")
    y = y if config.objective == "absolute" else F.when(y.isNull(), y).otherwise(clip(y))
    numbers = [c for c in columns if c not in categorical]
    keyed = train.select(*[F.col(c).cast("double").alias(c) for c in columns], y.alias("_y"), (F.col(by).cast("int") if by else F.lit(0)).alias("_m"))
    keyed = keyed.persist(StorageLevel.MEMORY_AND_DISK)
    stats = {r["_m"]: r for r in keyed.groupBy("_m").agg(F.count("*").alias("n"), F.sum(F.col("_y").cast("decimal(38,9)")).alias("y")).collect()}  # a row per model
    if not stats:
        raise GuardError("no rows to train on")
    models = tuple(sorted(stats))
    total = sum(r["n"] for r in stats.values())
    edges = bin_edges(keyed, numbers, config.bins)[0] if numbers else {}
    layout = Layout(tuple(columns), tuple(edges.get(c) for c in columns), models, target, by)
    parts = max(1, math.ceil(total / config.block_rows))
    # enough blocks for all cores, as long as they are worth a task
    parts = max(parts, min(spark.sparkContext.defaultParallelism, math.ceil(total / 4096)))
    # no pass carries the plan that the rows come from
    blocks = checkpointed(keyed.repartition(parts).mapInArrow(partial(_pack, layout), _BLOCK)).persist(StorageLevel.MEMORY_AND_DISK)
    keyed.unpersist()
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def reducers(nodes: int, width: int) -> int:
        """Tasks for the sums of so many nodes, of so many bytes from each block."""
        return max(1, min(most, math.ceil(nodes * width * parts / REDUCED_BYTES)))

    width = 24 * sum(config.bins if e is None else len(e) + 2 for e in layout.edges)

    trees: dict[int, list[Tree]] = {m: [] for m in models}
    if config.objective == "absolute":
        root = Tree([-1], [-1], [None], [-1], [-1], [0.0], [0.0])
        medians = leaf_medians(blocks, layout, {i: root for i in range(len(models))}, reducers(len(models), COUNT_BYTES))
        start = {i: medians[i * NODES] for i in range(len(models))}
    else:
        start = {i: math.log(max(float(stats[m]["y"]) / stats[m]["n"], 1e-9)) for i, m in enumerate(models)}
    steps: dict = start
    open_ = set(range(len(models)))
    for round_ in range(config.rounds):
        before, blocks = blocks, blocks.mapInArrow(partial(_advanced, layout, steps), _BLOCK).persist(StorageLevel.MEMORY_AND_DISK)
        if round_ and round_ % config.cut_rounds == 0:
            cut = checkpointed(blocks).persist(StorageLevel.MEMORY_AND_DISK)
            cut.count()
            blocks.unpersist()
            blocks = cut
        growing = {m: Growing(config) for m in open_}
        while wanted := {m: w for m, t in growing.items() if (w := t.wanted())}:
            asked, back = {}, {}
            for m, nodes in wanted.items():
                tree, at = growing[m].tree()
                asked[m] = tree, [at[v] for v in nodes]
                back |= {m * NODES + at[v]: v for v in nodes}
            sums = blocks.mapInArrow(partial(_histograms, layout, config, asked), _SUMS)
            met = sums.repartition(reducers(len(back), width), "feature", "node").sortWithinPartitions("feature", "node", "part")
            best: dict[int, object] = {}
            for r in met.mapInArrow(partial(_best_splits, layout, config), _SPLIT).collect():  # at most nodes times reducers
                if r["node"] not in best or (-r["gain"], r["feature"]) < (-best[r["node"]]["gain"], best[r["node"]]["feature"]):
                    best[r["node"]] = r
            for number, node in back.items():
                r = best.get(number)
                codes = np.frombuffer(r["codes"], np.int64) if r is not None and r["codes"] is not None else None
                split = None if r is None else (r["gain"], r["feature"], r["bin"], codes, (r["g"], r["h"], r["n"]), (r["left_g"], r["left_h"], r["left_n"]))
                growing[number // NODES].learn(node, split)
        before.unpersist()
        steps = {}
        for m, t in growing.items():
            order = t.order()
            if not order:
                open_ = open_ - {m}
                continue
            tree, at = t.tree(order)
            if config.objective != "absolute":
                for node, place in at.items():
                    g, h, _ = t.sums[node]
                    tree.value[place] = -config.rate * g / (h + config.ridge)
            steps[m] = tree
        if not steps:
            break
        if config.objective == "absolute":
            for number, value in leaf_medians(blocks, layout, steps, reducers(len(steps) * config.leaves, COUNT_BYTES)).items():
                steps[number // NODES].value[number % NODES] = config.rate * value
        for m, tree in steps.items():
            trees[models[m]].append(tree)
    blocks.unpersist()
    return Boosted(config, columns, categorical, list(layout.edges), by, {models[i]: s for i, s in start.items()}, trees)


def _predicted(model: Boosted, layout: Layout, name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        matrix = layout.matrix(batch)
        of = batch.column(batch.schema.get_field_index("_m")).to_pylist()
        score = np.zeros(batch.num_rows)
        for m in set(of):
            if m not in model.start:
                raise ValueError(f"no model for {model.by} {m}")
            rows = np.flatnonzero(np.array([x == m for x in of]))
            score[rows] = model.start[m]
            for tree in model.trees[m]:
                for leaf, mine in route(tree, matrix, rows).items():
                    score[mine] += tree.value[leaf]
        hat = score if model.config.objective == "absolute" else np.exp(score)
        n = len(batch.schema) - 1 - len(model.columns)
        yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(hat)], schema=pa.schema([*[batch.schema.field(i) for i in range(n)], (name, pa.float64())]))


def predict_boosted(model: Boosted, rows: DataFrame, name: str = "sales_hat") -> DataFrame:
    """``rows`` with a prediction, on the target's scale; a row without a model is an error."""
    on_executors(rows.sparkSession)
    layout = Layout(tuple(f"_f{i}" for i in range(len(model.columns))), tuple(model.edges), tuple(model.start), "", model.by)
    inputs = [F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(model.columns)]
    wide = rows.select("*", *inputs, (F.col(model.by).cast("int") if model.by else F.lit(0)).alias("_m"))
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])
    return wide.mapInArrow(partial(_predicted, model, layout, name), schema)
