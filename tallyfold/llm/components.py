"""Connected components of a graph given as a frame of edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


class Forest:
    """Union-find over dense places 0..n-1; the smallest member is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _contract(batches):
    """Edges of each batch replaced by stars: every node with its batch's smallest connected one."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(nodes))
        for x, y in zip(places[: len(a)].tolist(), places[len(a) :].tolist(), strict=True):
            forest.join(x, y)
        root = nodes[[forest.find(x) for x in range(len(nodes))]]
        keep = root != nodes
        yield pa.RecordBatch.from_pydict({"a": nodes[keep], "b": root[keep]})


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` has two long columns; the result has ``node`` and ``label``, the smallest node that
    it reaches, for every node of an edge between different nodes (an empty frame for none).

    Smallest labels spread along edges, and each label is replaced by its own label's label, so
    that paths halve at every step.  Every step is written to the shared folder.  Nulls are dropped.
    """
    a, b = edges.columns
    plain = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    stars = scratch.save(plain.mapInArrow(_contract, "a long, b long").distinct(), "stars")
    both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = scratch.save(
        both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels"
    )
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        of = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        jumped = spread.join(of, F.col("label") == F.col("at"), "left").select(
            "node", "old", F.least("label", F.coalesce("further", "label")).alias("label")
        )
        after = scratch.save(jumped, "labels")
        moved = after.filter("label <> old").limit(1).count()
        scratch.drop(labels)
        labels = after.select("node", "label")
        labels._scratch_path = after._scratch_path
        if not moved:
            return labels
