"""Scalar expressions of features, targets and predictions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """``x``, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), x)


def safe_ratio(top: Column, bottom: Column, fallback: float) -> Column:
    """``top / bottom``, or the fallback where that isn't a finite number."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(fallback))


def safe_zscore(value: Column, mean: Column, std: Column, fallback: float = 0.0) -> Column:
    return safe_ratio(value - mean, std, fallback)


def fallback(*columns: Column | str) -> Column:
    """The first of the columns that is known."""
    return F.coalesce(*columns)


def day_of_week(date: Column | str) -> Column:
    """Monday is 0."""
    return F.weekday(date)


def iso_week(date: Column | str) -> Column:
    return F.weekofyear(date)


def weekend(date: Column | str) -> Column:
    return (F.weekday(date) >= 5).cast("int")


def to_day(value: Column | str) -> Column:
    """A wall-clock day; what can't be read is null."""
    return F.coalesce(F.try_to_date(F.col(value) if isinstance(value, str) else value), F.lit(None).cast("date"))


def to_number(value: Column | str) -> Column:
    return finite((F.col(value) if isinstance(value, str) else value).try_cast("double"))


def submission_id(unique_id: str = "unique_id", date: str = "date") -> Column:
    return F.concat_ws("_", F.col(unique_id).cast("string"), F.date_format(date, "yyyy-MM-dd"))


def total(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns])


def positive_count(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [(F.col(c) > 0).cast("int") for c in columns])


def clip(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def transform_target(y: Column, how: str) -> Column:
    """``raw``, ``sqrt`` or ``log1p``, the latter two of the target clipped at 0."""
    return {"raw": y, "sqrt": F.sqrt(clip(y)), "log1p": F.log1p(clip(y))}[how]


def invert_target(z: Column, how: str, clip_first: bool = False) -> Column:
    """Back to the target's scale.  Squares lose the sign, so ``clip_first`` stops negatives before."""
    z = clip(z) if clip_first else z
    return {"raw": z, "sqrt": z * z, "log1p": F.expm1(z)}[how]


def blend(predictions: list[Column], weights: list[float]) -> Column:
    """The weighted sum of aligned predictions; weights have to sum to 1."""
    if len(predictions) != len(weights) or not predictions:
        raise ValueError("a blend needs one weight for each prediction")
    if abs(sum(weights) - 1) > 1e-12:
        raise ValueError("blend weights have to sum to 1")
    return reduce(lambda a, b: a + b, [p * F.lit(w) for p, w in zip(predictions, weights, strict=True)])


def suspicious(baseline: Column, model: Column, share: float = 0.2) -> Column:
    """An improvement of more than ``share`` of the baseline's error."""
    return (baseline - model) / baseline > share
