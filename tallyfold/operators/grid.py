"""The official request grid, its shifts to earlier cutoffs, and folds."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import submission_id
from .guards import CardinalityError, GuardError, check_unique, unique_rows, window_bounds

HORIZON = 14
#: Numbers of items that are counted together before places are summed up.
ITEM_BLOCK = 4096


@dataclass(frozen=True)
class Fold:
    name: str
    cutoff: date
    start: date
    end: date
    horizon: int


def make_folds(cutoffs: dict[str, date], horizon: int = HORIZON) -> list[Fold]:
    """Folds of disjoint windows."""
    folds = [Fold(name, c, *window_bounds(c, horizon), horizon) for name, c in cutoffs.items()]
    if len({f.cutoff for f in folds}) != len(folds):
        raise GuardError("a cutoff occurs twice")
    by_start = sorted(folds, key=lambda f: f.start)
    for a, b in zip(by_start, by_start[1:], strict=False):
        if b.start <= a.end:
            raise GuardError(f"the windows of {a.name} and {b.name} overlap")
    return folds


def fold_calendar(spark: SparkSession, folds: Iterable[Fold]) -> DataFrame:
    rows = [(f.name, f.cutoff, f.start, f.end, f.horizon) for f in folds]
    return spark.createDataFrame(rows, "fold string, cutoff date, start date, end date, horizon int")


def build_grid(requests: DataFrame, weights: DataFrame, origin: date, check: bool = True, horizon: int = HORIZON) -> DataFrame:
    """``grid_order``, ``unique_id``, ``test_date``, ``horizon_day``, ``weight`` of the official requests.

    Checked: keys unique, days exactly 1 to ``horizon`` after the origin, a finite weight >= 0 for each."""
    days = requests.select("unique_id", F.to_date("date").alias("test_date")).withColumn(
        "horizon_day", F.datediff("test_date", F.lit(origin)).cast("int")
    )
    weighed = weights.select("unique_id", F.col("weight").cast("double").alias("weight"))
    joined = days.join(unique_rows(weighed, ["unique_id"], "weights"), "unique_id", "left")
    if check:
        check_unique(requests, ["unique_id", "date"], "requests")
        check_unique(weights, ["unique_id"], "weights")
        r = joined.agg(
            F.count_if(F.col("horizon_day").isNull() | ~F.col("horizon_day").between(1, horizon)).alias("outside"),
            F.countDistinct("horizon_day").alias("days"),
            F.count_if(F.col("weight").isNull()).alias("missing"),
            F.count_if((F.col("weight") < 0) | F.isnan("weight") | (F.col("weight") == float("inf"))).alias("bad"),
        ).first()
        if r.outside or r.days != horizon:
            raise GuardError(f"the days aren't 1 to {horizon} after {origin}")
        if r.missing or r.bad:
            raise GuardError(f"{r.missing} requests without a weight, {r.bad} with a bad one")
    # a request's place: those of all smaller items, and those of its own item's earlier days
    per_item = joined.groupBy("unique_id").agg(F.count("*").alias("_n"))
    block = F.floor(F.col("unique_id") / ITEM_BLOCK)
    blocks = per_item.groupBy(block.alias("_block")).agg(F.sum("_n").alias("_m"))
    before_block = blocks.select("_block", (F.sum("_m").over(Window.orderBy("_block")) - F.col("_m")).alias("_a"))
    before = per_item.withColumn("_block", block).select(
        "unique_id", "_block", (F.sum("_n").over(Window.partitionBy("_block").orderBy("unique_id")) - F.col("_n")).alias("_b")
    ).join(before_block, "_block").select("unique_id", (F.col("_a") + F.col("_b")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("unique_id").orderBy("test_date")) - 1
    return joined.join(before, "unique_id").select((F.col("_before") + within).cast("long").alias("grid_order"), "unique_id", "test_date", "horizon_day", "weight")


def shift_grid(grid: DataFrame, folds: DataFrame) -> DataFrame:
    """The grid at each fold's cutoff: ids, days after the origin and weights stay."""
    return grid.crossJoin(F.broadcast(folds.select("fold", "cutoff"))).select(  # a handful of folds
        "fold", "cutoff", "grid_order", "unique_id", F.date_add("cutoff", F.col("horizon_day")).alias("date"), "horizon_day", "weight"
    )


def check_template(grid: DataFrame, template: DataFrame) -> None:
    """The template (``place``, ``id``) lists the grid's ids in its order."""
    wanted = grid.select(F.col("grid_order").alias("place"), submission_id("unique_id", "test_date").alias("wanted"))
    r = wanted.join(template.select("place", "id"), "place", "full_outer").agg(F.count_if(~F.col("wanted").eqNullSafe(F.col("id"))).alias("n")).first()
    if r.n:
        raise GuardError(f"{r.n} places of the template differ from the grid")


def alignment(labels: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Matched, missing and extra keys; rows are grouped by all keys but the last two."""
    by = keys[:-2]
    left = labels.select(*keys, F.lit(1).alias("_l"))
    right = predictions.select(*keys, F.lit(1).alias("_r"))
    return left.join(right, keys, "full_outer").groupBy(*by).agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("matched"),
        F.count_if(F.col("_r").isNull()).alias("missing"),
        F.count_if(F.col("_l").isNull()).alias("extra"),
    )


def check_alignment(labels: DataFrame, predictions: DataFrame, keys: list[str]) -> None:
    for name, df in (("labels", labels), ("predictions", predictions)):
        if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
            raise CardinalityError(f"{name}: {keys} isn't unique")
    whole = ["_all", *keys]
    found = alignment(labels.withColumn("_all", F.lit(0)), predictions.withColumn("_all", F.lit(0)), whole)
    r = found.agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"), F.coalesce(F.sum("extra"), F.lit(0)).alias("extra")).first()
    if r.missing or r.extra:
        raise GuardError(f"labels and predictions differ: missing={r.missing} extra={r.extra}")
