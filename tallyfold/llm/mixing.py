"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Each source has a token constraint.  Among all rates that meet it, those closest to one in relative
entropy are exponential in a document's size, ``rate = min(cap, exp(tilt * size / mean))`` with one
``tilt`` per source, the solution of a convex dual.  Newton steps, guarded by a bracket, find all
tilts at once; each step is one aggregation over the histogram of sizes, never over documents.
Rates are rounded into copies so that the rounding errors of a source cancel.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

#: No document is taken more often than this.
CAP = 3
#: Documents of one source and size that are ranked in one task.
CELL_ROWS = 4096
#: Characters of all names of sources up to which one row per source is sent to every task.
BROADCAST_CHARS = 4_000_000
#: The relative miss of a source's target at which its tilt is good enough, and the most steps.
MISS, STEPS = 1e-9, 120


def words_in(text: Column) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: DataFrame | None = None, cap: float = CAP) -> DataFrame:
    """``sizes``: one row per ``source`` with ``source_size``.  Adds ``weight`` and ``target``.

    Without ``weights`` (``source``, ``weight``) sources weigh 1, 2, 3, repeating, by code point,
    null last; one that ``weights`` lacks, or gives a weight of 0 or less, gets nothing.  Targets share the sum of all sizes by weight; one above ``cap`` times its source's
    size stops there, and the excess goes to the others by weight.  So all targets are
    ``min(cap * size, level * weight)``, and the level is the highest of those that result when the
    sources of the lowest caps per weight are taken as full.
    """
    if weights is None:
        place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
        sized = sizes.withColumn("weight", ((place - 1) % 3 + 1).cast("double"))
    else:
        w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        sized = sizes.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        sized = sized.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0))
    full = F.col("source_size") * F.lit(float(cap))
    by_cap = Window.orderBy(F.try_divide(full, F.col("weight")).asc_nulls_last(), F.col("source"))
    used = F.coalesce(F.sum(full).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    level = sized.withColumn("level", F.when(F.col("weight") > 0, (total - used) / open_weight))
    top = F.max("level").over(Window.partitionBy())
    return level.withColumn("target", F.least(full, F.coalesce(top, F.lit(0.0)) * F.col("weight"))).drop("level")


def _rate(cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(math.log(cap) + 1))))


def tilts(hist: DataFrame, goals: DataFrame, scratch: Scratch, cap: float = CAP, few: bool = False) -> DataFrame:
    """``hist``: ``key``, ``size``, ``n``; ``goals``: ``key``, ``target``.  One row per source with
    its ``mean`` and ``tilt``; a source whose target is its cap, or 0, has none.  ``few``: sources are
    few enough to be sent to every task.

    A step is one join and one aggregation, which carries the source's row along: plans and jobs of
    many steps fill the driver's memory, however small the tables are."""
    shape = hist.filter("size > 0").groupBy("key").agg(
        F.sum(F.col("size") * F.col("n")).cast("double").alias("whole"),
        (F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")) / F.sum(F.col("size") * F.col("n"))).alias("mean"),
        F.min("size").cast("double").alias("least"),
    )
    start = shape.join(goals.select("key", "target"), "key").filter((F.col("target") > 0) & (F.col("target") < F.col("whole") * (cap - 1e-9)))
    share = F.log(F.greatest(F.col("target"), F.lit(1e-9)) / F.col("whole"))
    state = scratch.save(
        start.select(
            "key", "mean", "target",
            F.least(share, F.lit(math.log(cap)) * F.col("mean") / F.col("least")).alias("tilt"),
            (F.lit(-800.0) * F.col("mean") / F.col("least")).alias("low"),
            (F.lit(math.log(cap)) * F.col("mean") / F.col("least")).alias("high"),
            F.lit(False).alias("done"),
        ),
        "tilts",
    )
    for _ in range(STEPS):
        rated = hist.filter("size > 0").join(F.broadcast(state) if few else state, "key").withColumn("rate", _rate(cap))
        tokens = F.col("n") * F.col("size") * F.col("rate")
        slope = F.when(F.col("rate") < cap, tokens * F.col("size") / F.col("mean")).otherwise(0.0)
        same = [F.first(c).alias(c) for c in ("mean", "target", "tilt", "low", "high", "done")]  # a source's row, at each of its sizes
        sums = rated.groupBy("key").agg(F.sum(tokens).alias("have"), F.sum(slope).alias("slope"), *same)
        miss = F.col("have") - F.col("target")
        low = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.try_divide(miss, F.col("slope"))
        inside = newton.isNotNull() & (newton > low) & (newton < high)
        good = F.abs(miss) <= F.col("target") * MISS
        stepped = sums.select(
            "key", "mean", "target",
            F.when(F.col("done") | good, F.col("tilt")).when(inside, newton).otherwise((low + high) / 2).alias("tilt"),
            F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"),
            F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
            (F.col("done") | F.coalesce(good, F.lit(True))).alias("done"),
        )
        after = scratch.save(stepped, "tilts")
        scratch.drop(state)
        state = after
        if state.filter("not done").isEmpty():
            break
    else:
        worst = state.filter("not done").select("key").first()
        raise RuntimeError(f"no tilt meets the target of source {worst.key!r} within {STEPS} steps")
    return state.select("key", "mean", "tilt")


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, cap: int = CAP, row: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``, ``source``; other columns ignored):
    ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``, ``copies``, ``rate``.

    A null or empty text has size 0 and is taken once, which adds nothing.  Null is a source of its
    own, the last.  Rows that repeat are documents of their own; of equal rows any may be the one
    that gets a further copy, so the result is the same.  ``row`` names a column of unique numbers, which
    comes back as ``row``.  A text of any length is one regular expression's count.  A null ``doc_id`` is a value like others.
    A source without words has target 0.  An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    sized = scratch.save(docs.select("doc_id", F.col("source").cast("string").alias("source"), key.alias("key"), words_in(F.col("text")).alias("size"), (F.col(row).cast("long") if row else F.monotonically_increasing_id()).alias("uid")), "sizes")
    hist = scratch.save(sized.groupBy("key", "source", "size").agg(F.count("*").alias("n")), "histogram")
    sizes = hist.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    goals = scratch.save(targets(sizes, weights, cap), "targets")
    # a row per source: sent to the sizes and documents, so that those of a large source stay where they are
    few = goals.agg(F.coalesce(F.sum(F.length("key") + 24), F.lit(0)).alias("chars")).first().chars <= BROADCAST_CHARS
    found = tilts(hist, goals, scratch, cap, few)

    full = (F.col("source_size") > 0) & F.col("tilt").isNull()
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("target") <= 0, 0.0).when(full, float(cap)).otherwise(_rate(cap))
    # Cells: documents of one source and size, which have one rate; large cells are dealt into parts.
    cells = scratch.save(
        hist.join(goals.select("key", "source_size", "target"), "key").join(found, "key", "left").select(
            "key", "size", "source_size", "target", rate.alias("rate"), F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("parts")
        ),
        "cells",
    )
    lot = F.xxhash64("doc_id", "key", "size", F.lit(17))
    dealt = sized.join(cells, ["key", "size"]).withColumn("lot", lot).withColumn("part", F.pmod(F.col("lot"), F.col("parts")).cast("int"))
    counted = dealt.groupBy("key", "size", "part").agg(F.count("*").alias("m"), F.first("rate").alias("rate"))
    # Error diffusion along sizes: a source's further copies never stray by more than half of one.
    along = Window.partitionBy("key").orderBy("size", "part").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.col("m") * (F.col("rate") - F.floor("rate"))).over(along)
    own = F.col("m") * (F.col("rate") - F.floor("rate"))
    further = scratch.save(
        counted.withColumn("upto", upto).select(
            "key", "size", "part", (F.floor(F.col("upto") + 0.5) - F.floor(F.col("upto") - own + 0.5)).cast("long").alias("further")
        ),
        "further",
    )
    rank = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("lot", "doc_id"))
    ranked = dealt.withColumn("rank", rank).join(further, ["key", "size", "part"])
    copies = F.least(F.lit(cap), F.floor("rate") + (F.col("rank") <= F.col("further")).cast("int")).cast("long")
    taken = scratch.save(
        ranked.select("doc_id", "source", "key", "size", "source_size", "target", copies.alias("copies"), "rate", "lot", "uid"), "taken"
    )
    # What is still off after rounding is mended by one copy more or less of the document whose size comes nearest.
    off = scratch.save(taken.groupBy("key").agg((F.sum(F.col("copies") * F.col("size")) - F.first("target")).alias("off")).filter("off <> 0"), "off")
    off = F.broadcast(off) if few else off
    can = F.when(F.col("off") > 0, F.col("copies") > 0).otherwise(F.col("copies") < cap)
    gap = F.abs(F.col("size") - F.abs("off"))
    mend = taken.join(off, "key").filter(can & (gap < F.abs("off"))).groupBy("key").agg(
        F.min(F.struct(gap.alias("gap"), F.col("lot"), F.col("doc_id"), F.col("uid"), F.signum("off").cast("long").alias("less"))).alias("x")
    )
    less = mend.select(F.col("x.uid").alias("uid"), F.col("x.less").alias("less"))
    mended = taken.join(F.broadcast(less) if few else less, "uid", "left")  # at most a row per source
    mended = mended.withColumn("copies", F.col("copies") - F.coalesce("less", F.lit(0)))
    if row:
        mended = mended.withColumn("row", F.col("uid"))
    return mended.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate", *(["row"] if row else [])
    )
