"""Checks that fail closed: each runs one aggregate and raises a typed error."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..sources.schema import FIELDS, Availability


class GuardError(ValueError):
    """A contract of the data doesn't hold."""


class LeakageError(GuardError):
    """Information from after the cutoff."""


class UnknownFieldError(GuardError):
    """A field that the registry doesn't have."""


class CardinalityError(GuardError):
    """Keys that have to be unique and aren't."""


FORBIDDEN_REQUEST_FIELDS = {"sales", "weight", "total_orders", "availability", "id", "sales_hat"}


def window_bounds(cutoff: date, horizon: int) -> tuple[date, date]:
    """The first and last day of the window that follows a cutoff."""
    if isinstance(horizon, bool) or not isinstance(horizon, int) or horizon < 1:
        raise ValueError("the horizon has to be a positive whole number of days")
    return cutoff + timedelta(days=1), cutoff + timedelta(days=horizon)


def require_columns(df: DataFrame, columns: Iterable[str], name: str) -> None:
    missing, _ = column_difference(df, columns)
    if missing:
        raise GuardError(f"{name} lacks columns {missing}")


def column_difference(df: DataFrame, columns: Iterable[str]) -> tuple[list[str], list[str]]:
    """Wanted columns that the frame doesn't have, and columns of it that aren't wanted, each in their order."""
    columns = list(columns)
    return [c for c in columns if c not in df.columns], [c for c in df.columns if c not in columns]


def _late(df: DataFrame, condition, column: str):
    return df.agg(F.count_if(F.coalesce(condition, F.lit(True))).alias("n"), F.max(column).alias("latest")).first()


def check_history(df: DataFrame, cutoff: date, column: str = "date") -> DataFrame:
    """No day after the cutoff, and none unknown."""
    r = _late(df, F.to_date(column) > F.lit(cutoff), column)
    if r.n:
        raise LeakageError(f"{r.n} history rows after {cutoff}, the latest of {r.latest}")
    return df


def history_at(df: DataFrame, cutoff: date, column: str = "date") -> DataFrame:
    """Rows up to the cutoff, days normalised."""
    return df.withColumn(column, F.to_date(column)).filter(F.col(column) <= F.lit(cutoff))


def check_window(df: DataFrame, cutoff: date, horizon: int, column: str = "date") -> DataFrame:
    first, last = window_bounds(cutoff, horizon)
    r = _late(df, ~F.to_date(column).between(F.lit(first), F.lit(last)), column)
    if r.n:
        raise LeakageError(f"{r.n} rows outside {first} to {last}")
    return df


def check_sources(df: DataFrame, cutoff: date, column: str, name: str) -> DataFrame:
    """Days that a feature was taken from; unknown ones are fine."""
    r = df.agg(F.count_if(F.to_date(column) > F.lit(cutoff)).alias("n"), F.max(column).alias("latest")).first()
    if r.n:
        raise LeakageError(f"{name}: {r.n} source days after {cutoff}, the latest of {r.latest}")
    return df


def check_no_target(df: DataFrame, target: str = "sales") -> DataFrame:
    if target in df.columns:
        raise LeakageError(f"the target {target} is among the features")
    return df


def overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Different keys that both have."""
    return left.select(*keys).join(right.select(*keys), keys, "left_semi").distinct()


def check_disjoint(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    if overlap(left, right, keys).limit(1).count():
        raise LeakageError(f"rows with the same {keys} on both sides")


def check_unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise CardinalityError(f"{name}: {keys} isn't unique")
    return df


def required(rows: DataFrame, holds: Column, message: str | Column) -> DataFrame:
    """Rows of which all have to meet a condition: the query fails where one doesn't.

    The row's number, never below 0, keeps the optimizer from testing the condition on other frames' rows."""
    broken = ~F.coalesce(holds, F.lit(False)) & (F.monotonically_increasing_id() >= 0)
    said = message if isinstance(message, Column) else F.lit(message)
    return rows.filter(F.when(broken, F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))


def unique_rows(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows, of which no two may have the same keys; rows with a null among them are left as they are.

    Copies are counted where the rows meet by key, so a join by the same keys that follows moves nothing again."""
    copies = F.count("*").over(Window.partitionBy(*keys))
    whole = ~F.greatest(*[F.col(c).isNull() for c in keys], F.lit(False))
    counted = df.withColumn("_copies", F.when(whole, copies).otherwise(1))
    said = F.concat(F.lit(f"{name}: several rows of "), F.to_json(F.struct(*keys)))
    return required(counted, F.col("_copies") == 1, said).drop("_copies")


def joined(left: DataFrame, right: DataFrame, keys: list[str], name: str, how: str = "m:1", match: str = "left") -> DataFrame:
    """A join that fails, in its own pass, where it isn't what it is meant to be.

    ``how``: ``m:1`` (keys of ``right`` unique) or ``1:1`` (of both).  ``match``: ``left`` (each row of
    ``left`` has one in ``right``), ``both`` (and the other way round), or ``any`` (a left join)."""
    if how not in ("m:1", "1:1") or match not in ("left", "both", "any"):
        raise ValueError(f"no such join: {how}, {match}")
    left = unique_rows(left, keys, name) if how == "1:1" else left
    right = unique_rows(right, keys, name)
    out = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), keys, "full_outer" if match == "both" else "left")
    which = F.to_json(F.struct(*keys))
    if match != "any":
        out = required(out, F.col("_r"), F.concat(F.lit(f"{name}: no match for "), which))
    if match == "both":
        out = required(out, F.col("_l"), F.concat(F.lit(f"{name}: an extra row of "), which))
    return out.drop("_l", "_r")


def join_to_one(left: DataFrame, right: DataFrame, keys: list[str], name: str, required: str | None = None) -> DataFrame:
    """A left join whose right side has to be unique by ``keys``, and to have ``required`` for every row."""
    out = left.join(check_unique(right, keys, name), keys, "left")
    if required and out.filter(F.col(required).isNull()).limit(1).count():
        raise GuardError(f"{name}: no {required} for some rows")
    return out


# --- guards that ride along: counted in the pass that computes the result


@dataclass(frozen=True)
class Guard:
    """What rows may not be (``broken``; unknown counts as broken), the day to name, and the error it is."""

    name: str
    broken: Column
    day: str | None = None
    error: type[GuardError] = GuardError


def no_later_than(cutoff: date | Column, column: str = "date", name: str = "history", unknown: bool = True) -> Guard:
    """No day after the cutoff; ``unknown`` days are broken too, unless they are those of a feature's source."""
    late = F.to_date(column) > (cutoff if isinstance(cutoff, Column) else F.lit(cutoff))
    return Guard(name, late if unknown else F.coalesce(late, F.lit(False)), column, LeakageError)


def within(cutoff: date | Column, horizon: int, column: str = "date", name: str = "window") -> Guard:
    """Days 1 to ``horizon`` after the cutoff."""
    origin = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    return Guard(name, ~F.datediff(F.to_date(column), origin).between(1, horizon), column, LeakageError)


def finite(column: str) -> Guard:
    x = F.col(column).cast("double")
    return Guard(f"finite_{column}", x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def not_negative(column: str) -> Guard:
    return Guard(f"not_negative_{column}", F.col(column) < 0)


class Verdict:
    """What the guards of a frame saw, once an action has run over it."""

    def __init__(self, guards: list[Guard], seen: Observation):
        self.guards, self._seen = guards, seen

    def counts(self) -> dict[str, tuple[int, date | None]]:
        """By guard the broken rows and the latest day among them."""
        got = self._seen.get
        return {g.name: (got[g.name], got.get(f"{g.name}_latest")) for g in self.guards}

    def check(self) -> None:
        """Raises the first broken guard's error, with the numbers of all."""
        bad = {n: c for n, c in self.counts().items() if c[0]}
        if bad:
            first = next(g for g in self.guards if g.name in bad)
            raise first.error("; ".join(f"{n}: {c} rows" + (f", the latest of {d}" if d is not None else "") for n, (c, d) in bad.items()))


def guarded(df: DataFrame, *guards: Guard) -> tuple[DataFrame, Verdict]:
    """The frame, and a verdict that is known after any action over all of its rows: no guard takes a job of its own."""
    seen = Observation()
    broken = [(g, F.coalesce(g.broken, F.lit(True))) for g in guards]
    counts = [F.count_if(b).alias(g.name) for g, b in broken]
    days = [F.max(F.when(b, F.to_date(g.day))).alias(f"{g.name}_latest") for g, b in broken if g.day]
    return df.observe(seen, *counts, *days), Verdict(list(guards), seen)


def classify(field: str) -> Availability:
    try:
        return FIELDS[field]
    except KeyError:
        raise UnknownFieldError(f"unknown field {field}") from None


def check_future_columns(columns: Iterable[str]) -> None:
    bad = [c for c in columns if classify(c) not in (Availability.KNOWN, Availability.STATIC)]
    if bad:
        raise GuardError(f"not known at forecast time: {bad}")


def future_covariates(df: DataFrame) -> DataFrame:
    """The columns that are known at forecast time, in their order; an unknown one is an error."""
    return df.select(*[c for c in df.columns if classify(c) in (Availability.KNOWN, Availability.STATIC)])


def check_request_fields(df: DataFrame) -> DataFrame:
    bad = FORBIDDEN_REQUEST_FIELDS.intersection(df.columns)
    if bad:
        raise LeakageError(f"requests carry {sorted(bad)}")
    return df


def check_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """All values known and finite."""
    bad = [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).alias(c) for c in columns]
    found = {c: n for c, n in df.agg(*bad).first().asDict().items() if n}
    if found:
        raise GuardError(f"values that aren't finite: {found}")
    return df


def frozen_audit(counters: DataFrame, expected: DataFrame, keys: list[str], most: float = 1e-15) -> DataFrame:
    """Scored rows and coverage of each split next to the frozen ones (``expected_rows``, ``expected_coverage``)."""
    both = counters.select(*keys, "scored_rows", "coverage").join(expected.select(*keys, "expected_rows", "expected_coverage"), keys, "full_outer")
    rows = F.coalesce(F.col("scored_rows") == F.col("expected_rows"), F.lit(False))
    near = F.coalesce(F.abs(F.col("coverage") - F.col("expected_coverage")) <= most, F.lit(False))
    return both.withColumns({"rows_match": rows, "coverage_match": near})


def check_frozen(counters: DataFrame, expected: DataFrame, keys: list[str], most: float = 1e-15) -> None:
    bad = frozen_audit(counters, expected, keys, most).filter("not (rows_match and coverage_match)").select(*keys).limit(5).collect()
    if bad:
        raise GuardError(f"scored rows or coverage differ from the frozen contract: {[tuple(r) for r in bad]}")


def violations(rows: DataFrame, by: list[str], cutoff: str, horizon: int, date_: str = "date", finite: Iterable[str] = ()) -> DataFrame:
    """Per group the rows before, inside and after the window that follows the cutoff, repeated keys, and
    values that are unknown or not finite: what the checks of this module raise on, as numbers."""
    far = F.datediff(date_, cutoff)
    bad = [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).alias(f"bad_{c}") for c in finite]
    keyed = rows.withColumn("_copies", F.count("*").over(Window.partitionBy(*by, "unique_id", date_)))
    return keyed.groupBy(*by).agg(
        F.count_if(far <= 0).alias("before"), F.count_if(far.between(1, horizon)).alias("inside"), F.count_if(far > horizon).alias("after"),
        F.count_if(F.col("_copies") > 1).alias("repeated"), *bad,
    )


def missing_days(grid: DataFrame, horizon: int) -> DataFrame:
    """Per item the days of the horizon that are asked for, and those that aren't."""
    every = F.sequence(F.lit(1), F.lit(horizon))
    days = grid.groupBy("unique_id").agg(F.sort_array(F.collect_set(F.col("horizon_day").cast("int"))).alias("days"))  # of at most as many days
    return days.select("unique_id", F.size("days").cast("long").alias("days"), F.array_join(F.array_except(every, "days"), ",").alias("missing"))
