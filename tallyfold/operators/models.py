"""Variants of the models, by boosted trees and by Spark ML's linear and plain tree models; training rows and checks."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip, invert_target, transform_target
from .boosting import BoostConfig, Boosted, fit_boosted, predict_boosted
from .features import CONTRACTS, category_codes, vocabulary_bounds
from .guards import GuardError, joined, required


@dataclass(frozen=True)
class TreeConfig:
    """Absolute-error boosting; the defaults are those of the full model, tests use fewer rounds."""

    rounds: int = 300
    rate: float = 0.05
    depth: int = 5
    least_rows: int = 100
    bins: int = 64
    seed: int = 42


def _assembled(columns: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error")


def with_categories(rows: DataFrame, columns: Iterable[str]) -> tuple[DataFrame, int]:
    """``rows`` with the columns marked as categories of codes from 0 on, and the largest number of codes.

    Marks are metadata, so categories of thousands of values (items, products) need no index of their own;
    a code that only appears later on is no member of any split's set."""
    columns = list(columns)
    if not columns:
        return rows, 0
    top = rows.agg(*[F.max(c).alias(c) for c in columns]).first()
    sizes = {c: int(top[c] or 0) + 1 for c in columns}
    marked = {c: F.col(c).cast("double").alias(c, metadata={"ml_attr": {"type": "nominal", "num_vals": max(2, n), "name": c}}) for c, n in sizes.items()}
    return rows.select(*[marked.get(c, F.col(c)) for c in rows.columns]), max(sizes.values())


def item_codes(rows: DataFrame, inventory: DataFrame, columns: Iterable[str] = ("unique_id", "product_unique_id")) -> DataFrame:
    """Numbers of items and products replaced by dense codes of the inventory's vocabulary; one that is not in it is an error."""
    columns = list(columns)
    bounds = vocabulary_bounds(inventory, columns)
    for c in columns:
        codes = category_codes(inventory, c, bounds[c]).withColumnRenamed("code", "_code")
        rows = joined(rows, codes, [c], f"a {c} that the vocabulary doesn't have").withColumn(c, F.col("_code")).drop("_code")
    return rows


def aligned(features: DataFrame, labels: DataFrame, keys: Iterable[str] = ("unique_id", "date"), values: Iterable[str] = ("sales", "weight")) -> DataFrame:
    """Training rows: each feature row with its one label; a row without one, or with a null target, is an error."""
    keys, values = list(keys), list(values)
    out = joined(features, labels.select(*keys, *values), keys, "training labels", how="1:1")
    return required(out, F.col(values[0]).isNotNull(), "a training row without a target")


def fit_trees(
    train: DataFrame, config: TreeConfig = TreeConfig(), columns: list[str] | None = None, target: str = "sales", categorical: Iterable[str] = ()
) -> PipelineModel:
    """Gradient-boosted trees for the absolute error; ``categorical`` columns hold codes from 0 on."""
    columns = list(columns or CONTRACTS[91])
    marked, most = with_categories(train, [c for c in categorical if c in columns])
    trees = GBTRegressor(
        featuresCol="features", labelCol=target, lossType="absolute", maxIter=config.rounds, stepSize=config.rate, maxDepth=config.depth,
        minInstancesPerNode=config.least_rows, maxBins=max(config.bins, most), seed=config.seed,
    )
    return Pipeline(stages=[_assembled(columns), trees]).fit(marked)


def fit_tweedie(train: DataFrame, power: float = 1.1, columns: list[str] | None = None, target: str = "sales", ridge: float = 0.1) -> PipelineModel:
    """A log-linear model with a Tweedie likelihood (power 1: Poisson); negative targets count as 0."""
    columns = list(columns or CONTRACTS[91])
    line = GeneralizedLinearRegression(
        family="tweedie", variancePower=power, linkPower=0.0, labelCol="_target", featuresCol="features", regParam=ridge, maxIter=50
    )
    return Pipeline(stages=[_assembled(columns), line]).fit(train.withColumn("_target", clip(F.col(target))))


@dataclass(frozen=True)
class Variant:
    """An objective on a transformed target."""

    objective: str
    transform: str = "raw"
    power: float | None = None


#: The variants that are compared with the first one.
VARIANTS = {
    "raw_l1": Variant("absolute"),
    "sqrt_l1": Variant("absolute", "sqrt"),
    "log1p_l1": Variant("absolute", "log1p"),
    "tweedie_1_1": Variant("tweedie", power=1.1),
    "tweedie_1_3": Variant("tweedie", power=1.3),
    "poisson": Variant("tweedie", power=1.0),
}


def fit_variant(train: DataFrame, name: str, config: TreeConfig = TreeConfig(), columns: list[str] | None = None, target: str = "sales", ridge: float = 0.1) -> PipelineModel:
    """The model of a variant; ``predict(..., VARIANTS[name].transform)`` brings predictions back."""
    variant = VARIANTS[name]
    if variant.objective == "tweedie":
        return fit_tweedie(train, variant.power, columns, target, ridge)
    return fit_trees(train.withColumn("_t", transform_target(F.col(target), variant.transform)), config, columns, "_t")


def fit_boosted_variant(
    train: DataFrame, name: str, config: BoostConfig = BoostConfig(), columns: Iterable[str] | None = None, target: str = "sales", categorical: Iterable[str] = (), by: str | None = None
) -> Boosted:
    """Boosted trees of a variant: its objective on its transformed target, everything else as ``config`` says."""
    variant = VARIANTS[name]
    objective = "absolute" if variant.objective == "absolute" else "poisson" if variant.power == 1.0 else "tweedie"
    config = replace(config, objective=objective, power=variant.power or config.power)
    return fit_boosted(train.withColumn("_t", transform_target(F.col(target), variant.transform)), config, columns or CONTRACTS[91], "_t", categorical, by)


def predict_boosted_variant(model: Boosted, rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``sales_hat`` on the target's own scale."""
    return predict_boosted(model, rows).withColumn("sales_hat", invert_target(F.col("sales_hat"), VARIANTS[name].transform))


def predict(model: PipelineModel, rows: DataFrame, how: str = "raw") -> DataFrame:
    """``rows`` with ``sales_hat``; ``check_predictions`` tells whether all are numbers."""
    return model.transform(rows).withColumn("sales_hat", invert_target(F.col("prediction"), how)).drop("features", "prediction")


def check_predictions(rows: DataFrame, predictions: DataFrame, column: str = "sales_hat") -> DataFrame:
    """One finite prediction for each row."""
    x = F.col(column)
    r = predictions.agg(F.count("*").alias("n"), F.count_if(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).alias("bad")).first()
    if r.bad or r.n != rows.count():
        raise GuardError(f"{r.n} predictions, {r.bad} of them not finite")
    return predictions


def horizon_counts(rows: DataFrame, horizon: int = 14) -> DataFrame:
    """Rows of each day of the horizon, and whether all days together are all rows."""
    per_day = rows.groupBy("horizon_day").agg(F.count("*").alias("rows"))
    inside = F.sum(F.when(F.col("horizon_day").between(1, horizon), F.col("rows")).otherwise(0)).over(Window.partitionBy())  # a row per day
    return per_day.withColumn("conserved", inside == F.sum("rows").over(Window.partitionBy()))


def fit_by_horizon(train: DataFrame, fit, horizons: range = range(1, 15)) -> dict[int, PipelineModel]:
    """One model per day of the horizon; ``fit`` takes that day's rows."""
    return {h: fit(train.filter(F.col("horizon_day") == h)) for h in horizons}


def predict_by_horizon(models: dict[int, PipelineModel], rows: DataFrame) -> DataFrame:
    """Each row by the model of its day; a day without a model is an error."""
    left = rows.filter(~F.col("horizon_day").isin(*models)).limit(1).count()
    if left:
        raise ValueError("requests for days without a model")
    parts = [predict(m, rows.filter(F.col("horizon_day") == h)) for h, m in models.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
