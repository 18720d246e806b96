"""Naive forecasts of all folds in one plan, in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import at_origins, in_last, mean_of, median_of, medians_at, series
from .guards import joined
from .split import Split

#: In the order of the registry, which breaks ties.
BASELINES = (
    "zero_forecast",
    "global_median",
    "last_observed_by_id",
    "same_weekday_last_week",
    "trailing_7_day_mean",
    "trailing_14_day_mean",
    "median_by_id_day_of_week",
)


def context(split: Split, folds: DataFrame) -> DataFrame:
    """The scored requests with everything that the baselines predict from."""
    known = split.history.select("unique_id", "date", "sales")
    cutoffs = sorted({r[0] for r in folds.select("cutoff").distinct().collect()})  # one date per fold
    sales = lambda days: F.transform(days, lambda d: d["sales"])
    of_weekday = lambda w: F.filter("seen", lambda d: F.weekday(d["date"]) == w)
    item = at_origins(series(known, "sales"), cutoffs, "cutoff").select(
        "cutoff", "unique_id", F.try_element_at("seen", F.lit(-1))["sales"].alias("last"),
        *[mean_of(sales(in_last(d, "cutoff"))).alias(f"mean_{d}") for d in (7, 14)],
        F.transform(F.sequence(F.lit(0), F.lit(6)), lambda w: median_of(sales(of_weekday(w)))).alias("by_weekday"),
    )
    overall = medians_at(known, cutoffs, [], "sales", "overall", "cutoff")
    week_ago = known.select("unique_id", F.date_add("date", 7).alias("date"), F.col("sales").alias("week_ago"))
    rows = split.requests.select("fold", "cutoff", "unique_id", "date", "horizon_day")
    rows = rows.join(F.broadcast(overall), "cutoff", "left").join(item, ["cutoff", "unique_id"], "left")  # one row per fold
    rows = rows.withColumn("weekday_median", F.get("by_weekday", F.weekday("date"))).drop("by_weekday")
    rows = rows.join(week_ago, ["unique_id", "date"], "left")
    return rows.withColumn("week_ago", F.when(F.date_sub("date", 7) <= F.col("cutoff"), F.col("week_ago")))


def predict(rows: DataFrame, names: tuple[str, ...] = BASELINES) -> DataFrame:
    """``fold``, ``baseline``, keys, ``sales_hat``, and how far the fallback went: 0 not at all, 1 to the
    last observed value, 2 to the median of everything."""
    own = {
        "last_observed_by_id": F.col("last"),
        "same_weekday_last_week": F.col("week_ago"),
        "trailing_7_day_mean": F.col("mean_7"),
        "trailing_14_day_mean": F.col("mean_14"),
        "median_by_id_day_of_week": F.col("weekday_median"),
    }

    def entry(name: str) -> Column:
        if name == "zero_forecast":
            value, far = F.lit(0.0), F.lit(0)
        elif name == "global_median":
            value, far = F.col("overall"), F.lit(0)
        else:
            value = F.coalesce(own[name], F.col("last"), F.col("overall"))
            far = F.when(own[name].isNotNull(), 0).when(F.col("last").isNotNull(), 1).otherwise(2)
        return F.struct(F.lit(name).alias("baseline"), F.lit(BASELINES.index(name)).alias("place"), value.alias("sales_hat"), far.alias("far"))

    long = rows.withColumn("_e", F.explode(F.array(*[entry(n) for n in names])))
    return long.select("fold", "unique_id", "date", "horizon_day", "_e.*")


def fallback_counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("fold", "baseline").agg(
        F.count("*").alias("rows"), F.count_if(F.col("far") >= 1).alias("primary_fallback_rows"), F.count_if(F.col("far") == 2).alias("global_fallback_rows")
    )


def with_labels(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Each prediction with its label, of which there has to be exactly one."""
    return joined(predictions, labels.select("fold", "unique_id", "date", "sales", "weight"), ["fold", "unique_id", "date"], "labels")
