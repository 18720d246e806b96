"""Shards by a k-d tree: splits at exact weighted medians along the widest dimension of the metadata.

Each node of the tree holds so many shards and is cut where its bytes divide as its shards do, in the
dimension in which its rows lie farthest apart, until every leaf is one shard.  All nodes of a level are
cut together.  Rows never move for it: a row's node is an expression over the cuts so far, and a cut is
found by sums of bytes over bins of the rows' keys, finer in each pass (a bin that the cut falls into is
all that the next pass looks at).  Only these sums, bounded by nodes and bins, reach the driver.

A row's key in a dimension is its level there, then its text's hash, then its own: equal texts follow
each other, and only where a cut falls between them do they part.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, code_points

#: Bytes of a row beside its text.
ROW_BYTES = 16
#: Levels of a dimension, and bins of a pass: a power of two.
LEVEL_BITS = BIN_BITS = 10
HASH_BITS = 60
#: Bits of a key: level, text, row.
KEY_BITS = LEVEL_BITS + 2 * HASH_BITS
DIMENSIONS = ("_by_source", "_by_lang", "_by_size", "_by_density")
#: Rows of a lookup table up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def _positions(rows: DataFrame, column: str, scratch: Scratch) -> DataFrame:
    """For each value (nulls last) the share of all bytes that smaller ones have, as a level.

    Values are put in order by ranges; sums of ranges, a number for each partition, give every range its base."""
    weights = rows.groupBy(column).agg(F.sum("size").alias("_w"))
    ordered = weights.repartitionByRange(F.col(column).asc_nulls_last()).withColumn("_range", F.spark_partition_id())
    ordered = scratch.save(ordered, f"values-{column}")
    total, bases = 0, []
    for r in sorted(ordered.groupBy("_range").agg(F.sum("_w").alias("w")).collect()):  # a row per partition
        bases.append((r["_range"], total))
        total += r["w"]
    before = F.sum("_w").over(Window.partitionBy("_range").orderBy(F.col(column).asc_nulls_last())) - F.col("_w")
    based = ordered.withColumn("_b", before).join(F.broadcast(ordered.sparkSession.createDataFrame(bases, "_range int, _base long")), "_range")
    level = F.expr(f"cast(floor((_b + _base) / {max(total, 1)}D * {1 << LEVEL_BITS}) as int)")
    return based.select(F.col(column).alias("_value"), F.least(level, F.lit((1 << LEVEL_BITS) - 1)).alias(f"_by_{column}"))


def _looked_up(rows: DataFrame, table: DataFrame, on: Column, small: bool) -> DataFrame:
    return rows.join(F.broadcast(table) if small else table, on, "left")


def narrow(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """A row of numbers for each document: ``size``, ``text_crc32``, hashes and levels in all dimensions.

    Copies of a text lie where the one of the smallest source and language lies."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), code_points(text).alias("_points"), F.crc32(text).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - HASH_BITS).alias("_text"),
    )
    rows = scratch.save(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    same = ["_text", "text_crc32", "size"]
    place = F.struct("source", "lang")
    spread = rows.groupBy(*same).agg(F.min(place).alias("_at"), F.max(place).alias("_to")).filter("_at <> _to").drop("_to")
    spread = scratch.save(spread, "spread")
    both = [F.col(c) == F.col(f"_of{c}") for c in same]
    named = spread.select(*[F.col(c).alias(f"_of{c}") for c in same], "_at")
    rows = _looked_up(rows, named, both[0] & both[1] & both[2], spread.count() <= BROADCAST_ROWS).drop(*[f"_of{c}" for c in same])
    rows = rows.withColumns({c: F.when(F.col("_at").isNull(), F.col(c)).otherwise(F.col(f"_at.{c}")) for c in ("source", "lang")}).drop("_at")
    rows = scratch.save(rows, "placed")
    for c in ("source", "lang"):
        table = _positions(rows, c, scratch)
        rows = _looked_up(rows, table, F.col(c).eqNullSafe(F.col("_value")), table.count() <= BROADCAST_ROWS).drop("_value", c)
    bytes_ = F.col("size") - ROW_BYTES
    levels = 1 << LEVEL_BITS
    # 40 doublings hold any text; a code point has one to four bytes
    by_size = F.floor(F.least(F.log2(F.col("size")) / 40, F.lit(0.9999)) * levels).cast("int")
    density = F.when(bytes_ > 0, F.col("_points") / bytes_).otherwise(1.0)
    by_density = F.least(F.floor((density - 0.25) / 0.75 * levels), F.lit(levels - 1)).cast("int")
    return scratch.save(
        rows.select(
            "doc_id", "size", "text_crc32", "_row", "_text", F.shiftrightunsigned(F.xxhash64("doc_id", "_row"), 64 - HASH_BITS).alias("_own"),
            "_by_source", "_by_lang", by_size.alias("_by_size"), by_density.alias("_by_density"),
        ), "keys",
    )


@dataclass
class Node:
    """``first`` is its smallest shard; ``cut``, once found, is the smallest key on the right."""

    first: int
    shards: int
    dim: int = 0
    cut: int | None = None
    left: Node | None = None
    right: Node | None = None
    # while the cut is looked for: bits of it that are known, the bytes left of them and wanted left of it
    prefix: int = 0
    known: int = 0
    below: int = 0
    wanted: int = field(default=0)

    def leaves(self) -> list[Node]:
        return [self] if self.left is None else self.left.leaves() + self.right.leaves()

    def grow(self) -> None:
        half = self.shards // 2
        self.left, self.right = Node(self.first, half), Node(self.first + half, self.shards - half)


def _bits(value: int) -> tuple[int, int, int]:
    """A key's level, text and row."""
    mask = (1 << HASH_BITS) - 1
    return value >> 2 * HASH_BITS, value >> HASH_BITS & mask, value & mask


def _left_of(node: Node) -> str:
    level, text, own = _bits(node.cut)
    c = DIMENSIONS[node.dim]
    return f"({c} < {level} or {c} = {level} and (_text < {text} or _text = {text} and _own < {own}))"


def by_leaf(node: Node, value=lambda leaf: str(leaf.first)) -> str:
    """SQL of a value of the leaf that a row is in, by default its smallest shard."""
    if node.left is None:
        return value(node)
    return f"case when {_left_of(node)} then {by_leaf(node.left, value)} else {by_leaf(node.right, value)} end"


def _bin(node: Node) -> str:
    """SQL of the node and the next bits of a row's key, where it begins with what is known of the node's cut; null elsewhere."""
    if node.shards == 1 or node.cut is not None:
        return "cast(null as bigint)"
    level, text, own = _bits(node.prefix << KEY_BITS - node.known)
    hash_bits = node.known - LEVEL_BITS
    inside = f"{DIMENSIONS[node.dim]} = {level}"
    column, value, done = ("_text", text, hash_bits) if hash_bits < HASH_BITS else ("_own", own, hash_bits - HASH_BITS)
    if column == "_own":
        inside += f" and _text = {text}"
    if done:
        inside += f" and shiftright({column}, {HASH_BITS - done}) = {value >> HASH_BITS - done}"
    return f"case when {inside} then (shiftright({column}, {HASH_BITS - done - BIN_BITS}) & {(1 << BIN_BITS) - 1}L) + {node.first << BIN_BITS}L end"


def _advance(node: Node, bins: list[tuple[int, int, int]]) -> None:
    """Takes the next bits of the cut from (bin, bytes, rows) in order; done where the bin has a single row or no bits are left."""
    for bin_, weight, rows in bins:
        if node.below + weight >= node.wanted:
            node.prefix = node.prefix << BIN_BITS | bin_
            node.known += BIN_BITS
            if rows == 1 or node.known == KEY_BITS:
                after = node.below + weight - node.wanted < node.wanted - node.below
                node.cut = node.prefix + after << KEY_BITS - node.known
            return
        node.below += weight
    node.cut = 1 << KEY_BITS  # nothing to cut


def grow(rows: DataFrame, shards: int) -> Node:
    """The tree over the rows of ``narrow``."""
    root = Node(0, shards)
    while open_ := [n for n in root.leaves() if n.shards > 1]:
        # all dimensions' levels in one pass
        each = F.posexplode(F.array(*DIMENSIONS)).alias("dim", "bin")
        seen: dict[int, list[tuple]] = {n.first: [] for n in open_}
        levels = rows.select(F.expr(by_leaf(root)).alias("node"), "size", each).groupBy("node", "dim", "bin").agg(F.sum("size").alias("w"), F.count("*").alias("n"))
        for r in levels.collect():  # at most nodes times dimensions times levels
            if r["node"] in seen:
                seen[r["node"]].append((r["dim"], r["bin"], r["w"], r["n"]))
        for n in open_:
            of = [sorted((b, w, c) for d, b, w, c in seen[n.first] if d == dim) for dim in range(len(DIMENSIONS))]
            n.dim = int(np.argmax([x[-1][0] - x[0][0] if x else 0 for x in of]))
            total = sum(w for _, w, _ in of[n.dim])
            # of whole bytes, the nearest to the left shards' part
            n.wanted = max(1, (2 * total * (n.shards // 2) + n.shards) // (2 * n.shards)) if total else 0
            _advance(n, of[n.dim])
        while looking := [n for n in open_ if n.cut is None]:
            finer = rows.select(F.expr(by_leaf(root, _bin)).alias("bin"), "size").groupBy("bin").agg(F.sum("size").alias("w"), F.count("*").alias("n"))
            of = {n.first: [] for n in looking}
            for r in finer.collect():  # at most nodes times bins
                if r["bin"] is not None:
                    of[r["bin"] >> BIN_BITS].append((r["bin"] & (1 << BIN_BITS) - 1, r["w"], r["n"]))
            for n in looking:
                _advance(n, sorted(of[n.first]))
        for n in open_:
            n.grow()
    return root


def _slots(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Numbers from 0 in each shard by ascending id: places in ordered ranges, and bases from prefix sums of their counts.

    A range of rows is one partition, whatever shards it spans, so no shard is sorted by one task."""
    order = ["shard", F.col("doc_id").asc_nulls_last(), "_text", "_row"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = scratch.save(ranged, "ranged").withColumn("_range", F.shiftright("_at", 33))
    # the ranges that a shard spans, a row each
    spans = ranged.groupBy("shard", "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    w = Window.partitionBy("shard").orderBy("_range")
    spans = spans.withColumn("_base", F.sum("_n").over(w) - F.col("_n")).select(F.col("shard").alias("_s"), F.col("_range").alias("_r"), "_first", "_base")
    both = ranged.join(F.broadcast(spans), (F.col("shard") == F.col("_s")) & (F.col("_range") == F.col("_r")))  # at most partitions plus shards rows
    return both.withColumn("slot", F.col("_base") + F.col("_at") - F.col("_first"))


def kd_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Each document with its shard: sizes of shards (``bytes`` law) are as near as whole documents allow.

    ``size`` is the text's UTF-8 bytes and 16 (null text: 16).  Dimensions are the source's and the
    language's place by bytes, the size's logarithm and the code points per byte.  At each cut the bytes
    on the left miss their part by half a document at most.  A null source or language comes after all
    others; a null id after all others of its shard.  Repeated rows are rows by themselves; which of
    them gets which slot makes no difference.  No rows give no rows.  Only ``doc_id``, ``text``,
    ``lang`` and ``source`` are read.  Very long texts are only measured and hashed, so they are of no concern but for
    the balance: a shard is no smaller than its largest document.  ``slot`` numbers a shard's rows from 0 by id.
    """
    scratch = Scratch(docs.sparkSession, "kd-shards")
    rows = narrow(docs, scratch)
    tree = grow(rows, shards)
    numbered = _slots(rows.select("doc_id", "size", "text_crc32", "_text", "_row", F.expr(by_leaf(tree)).cast("int").alias("shard")), scratch)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
