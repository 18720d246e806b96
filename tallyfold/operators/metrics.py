"""Weighted and relative errors, in one aggregate per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .guards import GuardError

METRICS = ("wmae", "wape", "bias")


def score(rows: DataFrame, by: list[str], actual: str = "sales", predicted: str = "sales_hat", weight: str = "weight") -> DataFrame:
    """``wmae``, ``wape``, ``bias`` and ``rows`` of each group; a zero denominator gives null."""
    y, p, w = F.col(actual), F.col(predicted), F.col(weight)
    off = F.abs(y - p)
    return rows.groupBy(*by).agg(
        F.try_divide(F.sum(w * off), F.sum(w)).alias("wmae"),
        F.try_divide(F.sum(off), F.sum(F.abs(y))).alias("wape"),
        F.try_divide(F.sum(p - y), F.sum(y)).alias("bias"),
        F.count("*").alias("rows"),
    )


def scorable_counts(rows: DataFrame, by: list[str] | None = None, actual: str = "sales", predicted: str = "sales_hat", weight: str = "weight") -> DataFrame:
    """What keeps rows from being scored: values that aren't finite, negative weights, and the sums that scores divide by."""
    def odd(c):
        return F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))

    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.count_if(odd(actual) | odd(predicted) | odd(weight)).alias("odd"),
        F.count_if(F.col(weight) < 0).alias("negative"), F.sum(weight).alias("w"), F.sum(F.abs(F.col(actual))).alias("y"), F.sum(actual).alias("s"),
    )


def check_scorable(rows: DataFrame, actual: str = "sales", predicted: str = "sales_hat", weight: str = "weight") -> DataFrame:
    """Rows, all finite, weights >= 0 with a positive sum, actuals that don't cancel."""
    r = scorable_counts(rows, None, actual, predicted, weight).first()
    if not r.n:
        raise GuardError("nothing to score")
    if r.odd:
        raise GuardError(f"{r.odd} rows with values that aren't finite")
    if r.negative or not r.w:
        raise GuardError("weights have to be 0 or more, and one of them more")
    if not r.y or not r.s:
        raise GuardError("the actual values sum to 0")
    return rows


def macro_average(scores: DataFrame, by: list[str]) -> DataFrame:
    """Unweighted means over folds, not pooled over rows."""
    return scores.groupBy(*by).agg(*[F.avg(m).alias(f"mean_{m}") for m in METRICS], F.count("*").alias("folds"), F.sum("rows").alias("rows"))


def ranking(means: DataFrame, order: str = "place") -> DataFrame:
    """Rank by mean WMAE, ties in the registry's order."""
    return means.withColumn("rank", F.row_number().over(Window.orderBy("mean_wmae", order)).cast("int"))


def best_per_fold(scores: DataFrame, name: str) -> DataFrame:
    return scores.groupBy("fold").agg(F.min_by(name, F.struct("wmae", name)).alias("best"), F.min("wmae").alias("best_wmae"))


def within_of_best(scores: DataFrame, room: float = 0.5) -> DataFrame:
    """Variants within ``room`` of their fold's best WMAE."""
    best = F.min("wmae").over(Window.partitionBy("fold"))
    return scores.withColumn("best_wmae", best).filter(F.col("wmae") <= F.col("best_wmae") + room)


def decision(scores: DataFrame, name: str, control: str, least_folds: int = 3) -> DataFrame:
    """Whether each variant beats the control: on the mean and in enough folds, compared fold by fold."""
    base = scores.filter(F.col(name) == control).select("fold", F.col("wmae").alias("control_wmae"))
    paired = scores.filter(F.col(name) != control).join(F.broadcast(base), "fold")  # a row per fold
    out = paired.groupBy(name).agg(
        F.avg("wmae").alias("mean_wmae"), F.avg("control_wmae").alias("control_mean"), F.count_if(F.col("wmae") < F.col("control_wmae")).alias("folds_won")
    )
    better = F.col("mean_wmae") < F.col("control_mean")
    verdict = F.when(better & (F.col("folds_won") >= least_folds), "supported").when(better, "inconclusive").otherwise("rejected")
    return out.withColumn("decision", verdict)


def gates(scores: DataFrame, wmae: float, wape: float, bias: float, rows: str, expected_rows: str, **most: float) -> DataFrame:
    """Acceptance of each score: WMAE below its limit, WAPE and the size of the bias at most theirs, the rows
    that were expected, any further column below its limit (``runtime_minutes=30``), and all of them at once."""
    checks = {
        "wmae_ok": F.col("wmae") < wmae, "wape_ok": F.col("wape") <= wape, "bias_ok": F.abs("bias") <= bias,
        "rows_ok": F.col(rows) == F.col(expected_rows), **{f"{c}_ok": F.col(c) < limit for c, limit in most.items()},
    }
    checks = {name: F.coalesce(c, F.lit(False)) for name, c in checks.items()}
    passed = F.lit(True)
    for c in checks.values():
        passed &= c
    return scores.withColumns({**checks, "passed": passed})


def is_close(a: Column, b: Column, most: float) -> Column:
    """Whether two numbers differ by ``most`` at the most; false where one is unknown or isn't a number."""
    return F.coalesce((F.abs(a - b) <= most) & ~F.isnan(a) & ~F.isnan(b), F.lit(False))


def reproduced(scores: DataFrame, reference: DataFrame, keys: list[str], most: float = 5e-10) -> DataFrame:
    """Whether scores are those of a reference, metric by metric; a key that one side lacks isn't."""
    theirs = reference.select(*keys, *[F.col(m).alias(f"_{m}") for m in METRICS])
    both = scores.select(*keys, *METRICS).join(theirs, keys, "full_outer")
    return both.select(*keys, *[is_close(F.col(m), F.col(f"_{m}"), most).alias(f"{m}_same") for m in METRICS])


def check_reproduced(scores: DataFrame, reference: DataFrame, keys: list[str], most: float = 5e-10) -> None:
    off = reproduced(scores, reference, keys, most).filter(~(F.col("wmae_same") & F.col("wape_same") & F.col("bias_same"))).limit(1).count()
    if off:
        raise GuardError(f"metrics differ from the reference by more than {most}")


def run_summary(runs: DataFrame, by: list[str], runtime: str = "runtime_seconds") -> DataFrame:
    """Macro means of the metrics over runs, with the sum, the mean and the maximum of their run times."""
    t = F.col(runtime)
    return runs.groupBy(*by).agg(
        *[F.avg(m).alias(f"mean_{m}") for m in METRICS], F.sum(t).alias("total_runtime"), F.avg(t).alias("mean_runtime"), F.max(t).alias("longest_runtime")
    )
