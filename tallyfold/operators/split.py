"""Cutoff-safe train and validation rows for all folds in one plan: the fold is a column."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schema import DISCOUNTS
from .grid import shift_grid


@dataclass(frozen=True)
class Split:
    history: DataFrame
    requests: DataFrame
    labels: DataFrame
    counters: DataFrame


def by_origin(history: DataFrame, origins: DataFrame | list[date], name: str = "cutoff", days: int | None = None) -> DataFrame:
    """Each history row once per origin that may see it (at most ``days`` old).

    ``origins``: dates, or a small frame of them, which become an array in the plan, so that rows are
    expanded where they are read and no join or shuffle is needed."""
    dates = sorted(set(origins) if isinstance(origins, list) else {r[0] for r in origins.select(name).distinct().collect()})
    seen = F.array(*[F.lit(d) for d in dates])
    if days is None:
        keep = F.filter(seen, lambda o: o >= F.col("date"))
    else:
        keep = F.filter(seen, lambda o: (o >= F.col("date")) & (F.date_sub(o, days) < F.col("date")))
    return history.withColumn(name, F.explode(keep))


def split(history: DataFrame, grid: DataFrame, folds: DataFrame) -> Split:
    """Training history, requests with what is known of their days, labels and counters per fold.

    History rows without a target are dropped and counted; a request is scored where the target of its
    day is known, others are counted as missing."""
    known = history.filter(F.col("sales").isNotNull())
    shifted = shift_grid(grid, folds)
    day = history.select("unique_id", "date", "sales", "sell_price_main", *DISCOUNTS)
    joined = shifted.join(day, ["unique_id", "date"], "left")
    scored = joined.filter(F.col("sales").isNotNull())
    requests = scored.select("fold", "cutoff", "unique_id", "date", "horizon_day", "sell_price_main", *DISCOUNTS)
    labels = scored.select("fold", "grid_order", "unique_id", "date", "horizon_day", "sales", "weight")
    seen = by_origin(history.select("date", "sales"), folds).groupBy("cutoff").agg(
        F.count("sales").alias("history_rows"), F.count_if(F.col("sales").isNull()).alias("excluded_rows")
    )
    asked = joined.groupBy("fold", "cutoff").agg(
        F.count("*").alias("requested_rows"), F.count("sales").alias("scored_rows"), F.count_if(F.col("sales").isNull()).alias("missing_rows")
    )
    counters = asked.join(seen, "cutoff", "left").withColumn("coverage", F.col("scored_rows") / F.col("requested_rows"))
    return Split(known, requests, labels, counters)
