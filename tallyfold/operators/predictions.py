"""Blends, clipping and submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import blend, clip, submission_id
from .grid import check_alignment
from .guards import GuardError, joined


def blend_frames(left: DataFrame, right: DataFrame, keys: list[str], weights: tuple[float, float] = (0.5, 0.5), check: bool | str = False) -> DataFrame:
    """The weighted sum of two predictions joined on their keys, unclipped and clipped at 0.

    ``check``: the two have to have the same keys, each once.  ``True`` looks before it joins and raises
    then; ``"plan"`` takes no job, the join itself fails."""
    if check is True:
        check_alignment(left, right, keys)
    one, two = left.select(*keys, F.col("sales_hat").alias("_a")), right.select(*keys, F.col("sales_hat").alias("_b"))
    both = joined(one, two, keys, "blend", how="1:1", match="both") if check == "plan" else one.join(two, keys)
    mixed = blend([F.col("_a"), F.col("_b")], list(weights))
    return both.select(*keys, mixed.alias("raw"), clip(mixed).alias("sales_hat"))


def clip_audit(blended: DataFrame, by: list[str]) -> DataFrame:
    return blended.groupBy(*by).agg(
        F.count("*").alias("rows"), F.count_if(F.col("raw") < 0).alias("negative_rows"), F.count_if(F.col("raw") != F.col("sales_hat")).alias("clipped_rows"),
        F.min("raw").alias("lowest"),
    )


def prediction_summary(df: DataFrame, column: str = "sales_hat") -> DataFrame:
    p = F.col(column)
    return df.agg(
        F.count("*").alias("rows"), F.min(p).alias("low"), F.max(p).alias("high"), F.avg(p).alias("mean"), F.median(p).alias("median"),
        F.count_if(p < 0).alias("negative_rows"), F.count_if(p.isNull()).alias("null_rows"),
    )


def submission(grid: DataFrame, predictions: DataFrame) -> DataFrame:
    """``grid_order``, ``id``, ``sales_hat`` by key; the grid decides on rows and their order."""
    p = predictions.select("unique_id", F.col("date").alias("test_date"), "sales_hat")
    return grid.join(p, ["unique_id", "test_date"], "left").select("grid_order", submission_id("unique_id", "test_date").alias("id"), "sales_hat")


def submission_audit(grid: DataFrame, sent: DataFrame) -> DataFrame:
    """Differences of a submission (``grid_order``, ``id``, ``sales_hat``) from the grid, in one row."""
    wanted = grid.select("grid_order", submission_id("unique_id", "test_date").alias("wanted"))
    both = wanted.join(sent, "grid_order", "full_outer")
    return both.agg(
        F.count("wanted").alias("grid_rows"), F.count("id").alias("rows"), (F.count("id") - F.countDistinct("id")).alias("duplicates"),
        F.count_if(F.col("id").isNotNull() & F.col("sales_hat").isNull()).alias("null_rows"), F.count_if(F.col("sales_hat") < 0).alias("negative_rows"),
        F.count_if(~F.col("wanted").eqNullSafe(F.col("id"))).alias("misplaced"),
    )


def check_submission(grid: DataFrame, sent: DataFrame) -> None:
    r = submission_audit(grid, sent).first()
    if r.grid_rows != r.rows or r.duplicates or r.null_rows or r.negative_rows or r.misplaced:
        raise GuardError(f"the submission is not as the grid wants it: {r.asDict()}")
