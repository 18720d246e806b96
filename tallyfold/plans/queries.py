"""Named queries of the engine over the supplied tables (``sf_dir``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import invert_target, suspicious, to_day, to_number, transform_target
from ..operators import baselines as B
from ..operators import boosting as BO
from ..operators import features as X
from ..operators import grid as G
from ..operators import metrics as M
from ..operators import guards as Q
from ..operators import predictions as P
from ..operators.profile import profile
from ..operators.split import Split, by_origin, split
from ..sources import fixtures as fx
from ..sources.schema import CALENDAR_FLAGS, CATEGORIES
from ..sources import tables as T
from ..sources.tables import stage_means
from .oracle import INT_FEATURES, NUDGE

Query = Callable[[SparkSession, str], DataFrame]
KEY = ["fold", "unique_id", "date"]


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "smallint") and c not in ("unique_id", "horizon_day") else F.col(c) for c, t in df.dtypes])


def _folds(spark: SparkSession) -> DataFrame:
    return G.fold_calendar(spark, G.make_folds(fx.FOLDS))


def _history(spark: SparkSession, sf: str, holes: bool = True) -> DataFrame:
    """The projected history, kept (in memory, or on disk beyond it): every part of a plan reads it.  The days' sums
    that it shares with the inventory are kept too, so the lines are read, joined and summed up once."""
    fx.daily(spark, sf).persist()
    return fx.history(spark, sf, holes).persist()


def _inventory(spark: SparkSession, sf: str) -> DataFrame:
    fx.daily(spark, sf).persist()
    return fx.inventory(spark, sf).persist()


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    inv = _inventory(spark, sf)
    return G.build_grid(fx.sales_test(inv), fx.weights(inv), fx.FINAL, check=False)


def _split(spark: SparkSession, sf: str, holes: bool = True) -> Split:
    return split(_history(spark, sf, holes), _grid(spark, sf), _folds(spark))


def predictions(spark: SparkSession, sf: str, names: tuple[str, ...] = B.BASELINES) -> DataFrame:
    s = _split(spark, sf)
    return B.with_labels(B.predict(B.context(s, _folds(spark)), names), s.labels)


def baseline_scores(spark: SparkSession, sf: str, names: tuple[str, ...] = B.BASELINES, holes: bool = True) -> DataFrame:
    """The flagship: all folds and baselines from scan to metrics in one plan."""
    s = _split(spark, sf, holes)
    rows = B.with_labels(B.predict(B.context(s, _folds(spark)), names), s.labels)
    return M.score(rows, ["fold", "baseline", "place"])


def _baseline(name: str) -> Query:
    return lambda spark, sf: _rounded(predictions(spark, sf, (name,)).select(*KEY, "sales_hat", F.col("far").cast("long").alias("far")))


def history_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    seen = by_origin(_history(spark, sf).select("date", "sales"), _folds(spark))
    counted = seen.groupBy("cutoff").agg(F.count("*").alias("rows"), F.count("sales").alias("known_rows"), F.max("date").alias("latest"), F.sum("sales").alias("sales"))
    return _rounded(counted.join(F.broadcast(_folds(spark).select("fold", "cutoff")), "cutoff").drop("cutoff"))


def disjoint_keys(spark: SparkSession, sf: str) -> DataFrame:
    s = _split(spark, sf)
    both = s.labels.select(*KEY).join(_folds(spark).select("fold", "cutoff"), "fold").join(s.history.select("unique_id", "date"), ["unique_id", "date"])
    counted = both.groupBy("fold").agg(F.count_if(F.col("date") <= F.col("cutoff")).alias("shared"), F.count("*").alias("shared_with_all"))
    return _folds(spark).select("fold").join(counted, "fold", "left").na.fill(0)


def alignment_audit(spark: SparkSession, sf: str) -> DataFrame:
    rows = predictions(spark, sf, ("zero_forecast",))
    mixed = F.col("unique_id") + F.col("horizon_day")
    changed = rows.filter(mixed % 17 != 0).withColumn("unique_id", F.when(mixed % 19 == 1, -F.col("unique_id")).otherwise(F.col("unique_id")))
    return G.alignment(_split(spark, sf).labels, changed, KEY)


def features(spark: SparkSession, sf: str, columns: tuple[str, ...]) -> DataFrame:
    s = _split(spark, sf)
    requests = s.requests.withColumnRenamed("cutoff", "origin")
    return X.feature_matrix(s.history, requests, _inventory(spark, sf), fx.calendar(spark, sf), columns, origins=list(fx.FOLDS.values()))


def _features(*columns: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = features(spark, sf, columns)
        return df.select(*[F.col(c) if c in ("origin", "date", "unique_id") else F.col(c).cast("long").alias(c) if c in INT_FEATURES else F.round(F.col(c) + NUDGE, 4).alias(c) for c in df.columns])

    return run


def _pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = predictions(spark, sf, ("trailing_14_day_mean", "median_by_id_day_of_week"))
    one, two = (rows.filter(F.col("baseline") == n) for n in ("trailing_14_day_mean", "median_by_id_day_of_week"))
    return rows, one, two


def _shifted_blend(spark: SparkSession, sf: str) -> DataFrame:
    _, one, two = _pair(spark, sf)
    less = F.col("sales_hat") - 20
    return P.blend_frames(one.withColumn("sales_hat", less), two.withColumn("sales_hat", less), KEY)


def variant_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The control, the other model and their two fixed blends."""
    rows, _, _ = _pair(spark, sf)
    wide = rows.groupBy(*KEY, "sales", "weight").agg(
        F.max(F.when(F.col("baseline") == "trailing_14_day_mean", F.col("sales_hat"))).alias("a"),
        F.max(F.when(F.col("baseline") == "median_by_id_day_of_week", F.col("sales_hat"))).alias("b"),
    )
    forms = {"control": F.col("a"), "other": F.col("b"), "blend_70_30": 0.7 * F.col("a") + 0.3 * F.col("b"), "blend_50_50": 0.5 * F.col("a") + 0.5 * F.col("b")}
    long = wide.withColumn("_v", F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), e.alias("sales_hat")) for n, e in forms.items()])))
    return M.score(long.select(*KEY, "sales", "weight", "_v.*"), ["fold", "variant"])


def target_transforms(spark: SparkSession, sf: str) -> DataFrame:
    y = F.col("sales") - 20
    s = _split(spark, sf).labels.select("fold", y.alias("y"))
    root, log = transform_target(F.col("y"), "sqrt"), transform_target(F.col("y"), "log1p")
    sums = {
        "raw": F.col("y"), "root": root, "log1p": log, "root_back": invert_target(root, "sqrt"), "log1p_back": invert_target(log, "log1p"),
        "square_unclipped": invert_target(F.col("y"), "sqrt"), "square_clipped": invert_target(F.col("y"), "sqrt", clip_first=True),
    }
    return s.groupBy("fold").agg(*[F.round(F.sum(e), 4).alias(n) for n, e in sums.items()], F.count_if(F.col("y") < 0).alias("negative_rows"))


def suspicious_flag(spark: SparkSession, sf: str) -> DataFrame:
    scores = baseline_scores(spark, sf)
    zero = scores.filter(F.col("baseline") == "zero_forecast").select("fold", F.col("wmae").alias("zero"))
    return scores.join(F.broadcast(zero), "fold").select("fold", "baseline", suspicious(F.col("zero"), F.col("wmae")).alias("suspicious"))


def submission(spark: SparkSession, sf: str) -> DataFrame:
    """Trailing 14-day means for the official requests, clipped at 0."""
    known = _history(spark, sf).filter(F.col("sales").isNotNull() & (F.col("date") <= F.lit(fx.FINAL)))
    item = known.groupBy("unique_id").agg(F.max_by("sales", "date").alias("last"), F.avg(F.when(F.col("date") > F.date_sub(F.lit(fx.FINAL), 14), F.col("sales"))).alias("mean"))
    overall = X.medians_at(known, [fx.FINAL], [], "sales", "overall")
    grid = _grid(spark, sf)
    p = grid.join(item, "unique_id", "left").crossJoin(F.broadcast(overall)).select(  # one row
        "unique_id", F.col("test_date").alias("date"), F.greatest(F.coalesce("mean", "last", "overall"), F.lit(0.0)).alias("sales_hat")
    )
    return P.submission(grid, p)


def training_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that each of the twelve training origins of the first fold contributes."""
    origins = [(d.isoformat(), d) for d in fx.origins(fx.FOLDS["F1"])]
    frame = spark.createDataFrame(origins, "fold string, cutoff date")
    s = split(_history(spark, sf), _grid(spark, sf), frame)
    return s.requests.groupBy(F.col("cutoff").alias("origin")).agg(F.count("*").alias("rows")).join(
        s.labels.groupBy(F.to_date("fold").alias("origin")).agg(F.round(F.sum("sales"), 6).alias("sales")), "origin"
    )


def results_log_means(spark: SparkSession, sf: str) -> DataFrame:
    log = baseline_scores(spark, sf).select(F.col("baseline").alias("stage"), *[F.col(m).alias(f"local_{m}") for m in M.METRICS])
    return _rounded(stage_means(log, ("trailing_7_day_mean", "trailing_14_day_mean")))


def tweedie_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A Tweedie model on twelve origins of the first fold, scored on its window."""
    from ..operators import models

    return _model_scores(spark, sf, lambda train, cols: models.fit_tweedie(train, 1.1, cols), "tweedie_1.1")


def tree_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Absolute-error trees of all 36 columns and nine categories with few rounds, scored like ``tweedie_scores``."""
    return _boosted_scores(spark, sf, BO.BoostConfig(rounds=5, rate=0.5, least_rows=20), "trees_l1")


def training_frame(spark: SparkSession, sf: str, columns: tuple[str, ...]) -> DataFrame:
    """Features and targets of the first fold's twelve training origins and of its own window."""
    from ..operators import models

    fold = fx.FOLDS["F1"]
    rows = [(d.isoformat(), d) for d in fx.origins(fold)] + [("F1", fold)]
    s = split(_history(spark, sf), _grid(spark, sf), spark.createDataFrame(rows, "fold string, cutoff date"))
    inv, cal = _inventory(spark, sf), fx.calendar(spark, sf)
    frame = X.feature_matrix(s.history, s.requests.withColumnRenamed("cutoff", "origin"), inv, cal, columns, origins=[d for _, d in rows])
    return models.aligned(frame, s.labels)


def _boosted_scores(spark: SparkSession, sf: str, config: BO.BoostConfig, name: str) -> DataFrame:
    from ..operators import models

    frame = models.item_codes(training_frame(spark, sf, X.BASE), _inventory(spark, sf)).cache()
    early, late = (frame.filter(one) for one in (F.col("origin") < F.lit(fx.FOLDS["F1"]), F.col("origin") == F.lit(fx.FOLDS["F1"])))
    model = BO.fit_boosted(early, config, X.BASE, categorical=X.CATEGORICAL)
    return M.score(BO.predict_boosted(model, late).withColumn("model", F.lit(name)), ["model"])


def _model_scores(spark: SparkSession, sf: str, fit, name: str) -> DataFrame:
    from ..operators import models

    cols = ("horizon_day", "day_of_week", "month", "sell_price_main", *X.BASE[24:])
    frame = training_frame(spark, sf, cols).cache()
    model = fit(frame.filter(F.col("origin") < F.lit(fx.FOLDS["F1"])), list(cols))
    return M.score(models.predict(model, frame.filter(F.col("origin") == F.lit(fx.FOLDS["F1"]))).withColumn("model", F.lit(name)), ["model"])


def aligned_targets(spark: SparkSession, sf: str) -> DataFrame:
    """What the aligned training rows of each origin hold."""
    frame = training_frame(spark, sf, ("horizon_day", "sell_price_main"))
    return frame.groupBy("origin").agg(F.count("*").alias("rows"), F.round(F.sum("sales"), 6).alias("sales"), F.round(F.sum(F.col("sales") * F.col("horizon_day")), 6).alias("moment"), F.round(F.sum("sell_price_main"), 4).alias("prices"))


def dense_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of items, products and second categories."""
    inv, out = _inventory(spark, sf), None
    columns = ["unique_id", "product_unique_id", CATEGORIES[1]]
    bounds = X.vocabulary_bounds(inv, columns)
    for c in columns:
        one = X.category_codes(inv, c, bounds[c]).select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.col("code").cast("long").alias("code"))
        out = one if out is None else out.unionByName(one)
    return out


def observed_guards(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of all folds moved by three days, written in one pass in which all guards count what they see."""
    s = _split(spark, sf)
    price = F.when(F.col("unique_id") % 4 != 0, F.col("sell_price_main") - F.when(F.col("unique_id") % 5 == 0, 1e9).otherwise(0.0))
    rows = s.requests.select("fold", "cutoff", "unique_id", F.date_add("date", 3).alias("date"), F.date_sub("date", 7).alias("source"), price.alias("price"))
    cutoff = F.col("cutoff")
    seen, verdict = Q.guarded(
        rows, Q.no_later_than(cutoff), Q.within(cutoff, fx.STEP), Q.no_later_than(cutoff, "source", "source", unknown=False), Q.finite("price"), Q.not_negative("price")
    )
    seen.write.parquet(T.shared_folder(spark, "guarded"))
    found = [(n, c, d.isoformat() if d else None) for n, (c, d) in verdict.counts().items()]
    return spark.createDataFrame(found, "guard string, rows long, latest string")  # a row per guard


def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The baselines' mean scores as lines of a Markdown table."""
    means = M.ranking(M.macro_average(baseline_scores(spark, sf), ["baseline", "place"])).select("baseline", *[F.col(f"mean_{m}").alias(m) for m in M.METRICS]).orderBy("wmae", "baseline")
    return spark.createDataFrame(list(enumerate(T.as_markdown(means).split("\n"))), "line long, text string")


def unscorable_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts of which some are unknown and some weights negative, by fold and baseline, as the check before scoring sees them."""
    rows = predictions(spark, sf, ("trailing_7_day_mean", "last_observed_by_id"))
    hat = F.when(F.col("unique_id") % 7 != 0, F.col("sales_hat"))
    weight = F.when(F.col("horizon_day") == 3, -F.col("weight")).otherwise(F.col("weight"))
    return _rounded(M.scorable_counts(rows.withColumns({"sales_hat": hat, "weight": weight}), ["fold", "baseline"]))


#: What the projection reads, and a column that no table has.
WANTED_COLUMNS = {
    "lineitem": ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_shipdate", "l_extendedprice", "l_absent"),
    "part": ("p_partkey", "p_brand", "p_absent"), "supplier": ("s_suppkey", "s_nationkey"),
}


def column_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Columns that a table lacks, and those of it that nothing reads, with their known values."""
    out = None
    for table, wanted in WANTED_COLUMNS.items():
        df = T.read_parquet(spark, sf, table)
        missing, extra = Q.column_difference(df, wanted)
        entries = [F.struct(F.lit(c).alias("column"), F.lit("missing").alias("kind"), F.lit(0).cast("long").alias("known")) for c in missing]
        entries += [F.struct(F.lit(c).alias("column"), F.lit("extra").alias("kind"), F.count(c).alias("known")) for c in extra]
        one = df.agg(F.array(*entries).alias("_")).select(F.lit(table).alias("table"), F.explode("_").alias("_")).select("table", "_.*")
        out = one if out is None else out.unionByName(one)
    return out


def submission_order(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of the submission's file by line, as the file has them."""
    folder = T.shared_folder(spark, "submission")
    T.write_submission(submission(spark, sf), folder)
    lines = spark.read.text(folder, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "text"))
    return lines.filter((F.col("line") > 0) & (F.col("text") != "")).select(F.col("line").cast("long").alias("line"), F.split("text", ",")[0].alias("id"))


def _horizon_counts(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import models

    return models.horizon_counts(_split(spark, sf).requests).select(F.col("horizon_day").cast("long").alias("horizon_day"), "rows", "conserved")


def ablation_checksums(spark: SparkSession, sf: str) -> DataFrame:
    """What each ablation that has columns trains on: their number, rows, and the sum of all cells."""
    frame = features(spark, sf, X.BASE).cache()
    parts = []
    for name, which in X.ABLATIONS.items():
        if which.columns:
            cells = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in which.columns]
            row = X.ablation(frame, name).agg(F.count("*").alias("rows"), F.round(F.sum(sum(cells[1:], cells[0])), 2).alias("cells"))
            parts.append(row.select(F.lit(name).alias("ablation"), F.lit(len(which.columns)).cast("long").alias("columns"), F.lit(len(which.categorical)).cast("long").alias("categories"), "rows", "cells"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def ablation_baselines(spark: SparkSession, sf: str) -> DataFrame:
    """The naive forecasts that stand beside the ablations, on the first fold."""
    names = {a.baseline: n for n, a in X.ABLATIONS.items() if a.baseline}
    scores = baseline_scores(spark, sf, tuple(names)).filter(F.col("fold") == "F1")
    named = F.coalesce(*[F.when(F.col("baseline") == b, F.lit(n)) for b, n in names.items()])
    return _rounded(scores.select(named.alias("ablation"), *M.METRICS, "rows"))


def coercing_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Days and numbers from strings of which some can't be read."""
    key = F.col("o_orderkey")
    text = T.read_parquet(spark, sf, "orders").select(
        "o_orderpriority",
        F.when(key % 7 == 0, "n/a").when(key % 11 == 0, "2001-13-45").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("day"),
        F.when(key % 5 == 0, "abc").when(key % 6 == 0, "NaN").when(key % 9 == 0, "Infinity").otherwise(F.round("o_totalprice", 2).cast("string")).alias("number"),
    )
    parsed = text.select("o_orderpriority", to_day("day").alias("day"), to_number("number").alias("number"))
    return parsed.groupBy("o_orderpriority").agg(
        F.count("*").alias("rows"), F.count("day").alias("days"), F.min("day").alias("earliest"), F.max("day").alias("latest"), F.count("number").alias("numbers"),
        F.round(F.sum("number"), 2).alias("total"),
    )


def gate_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Which baselines pass fixed limits in which folds, with all rows scored."""
    counted = _split(spark, sf).counters.select("fold", "scored_rows")
    scores = baseline_scores(spark, sf).join(F.broadcast(counted), "fold")  # a row per fold
    judged = M.gates(scores, wmae=17.5, wape=0.62, bias=0.1, rows="rows", expected_rows="scored_rows", place=6)
    return judged.select("fold", "baseline", "wmae_ok", "wape_ok", "bias_ok", "rows_ok", "place_ok", "passed")


def reproduced_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The control's scores against those of the same forecasts by another way, and against the other model's."""
    mixed, rows = variant_scores(spark, sf), baseline_scores(spark, sf, ("trailing_14_day_mean", "median_by_id_day_of_week"))
    control = mixed.filter(F.col("variant") == "control")
    parts = [M.reproduced(control, rows.filter(F.col("baseline") == b), ["fold"]).withColumn("reference", F.lit(b)) for b in ("trailing_14_day_mean", "median_by_id_day_of_week")]
    return parts[0].unionByName(parts[1])


def frozen_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The splits' counters against rows counted without the split."""
    known = _history(spark, sf).filter(F.col("sales").isNotNull()).select("unique_id", "date")
    shifted = G.shift_grid(_grid(spark, sf), _folds(spark))
    asked = shifted.groupBy("fold").agg(F.count("*").alias("asked"))
    hit = shifted.join(known, ["unique_id", "date"], "left_semi").groupBy("fold").agg(F.count("*").alias("expected_rows"))
    expected = asked.join(hit, "fold").select("fold", "expected_rows", (F.col("expected_rows") / F.col("asked")).alias("expected_coverage"))
    expected = expected.withColumn("expected_rows", F.when(F.col("fold") == "F4", F.col("expected_rows") + 1).otherwise(F.col("expected_rows")))
    return Q.frozen_audit(_split(spark, sf).counters, expected, ["fold"]).select("fold", "scored_rows", "expected_rows", "rows_match", "coverage_match")


def guard_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Requests moved by three days, some twice, some without a price, and what the guards see of it."""
    s = _split(spark, sf)
    rows = s.requests.select("fold", "cutoff", "unique_id", F.date_add("date", 3).alias("date"), F.when(F.col("unique_id") % 4 != 0, F.col("sell_price_main")).alias("price"))
    rows = rows.unionByName(rows.filter(F.col("unique_id") % 5 == 0))
    early = s.requests.select("fold", "cutoff", "unique_id", F.date_sub("date", 10).alias("date"), F.col("sell_price_main").alias("price")).filter(F.col("unique_id") % 3 == 0)
    return Q.violations(rows.unionByName(early), ["fold"], "cutoff", fx.STEP, finite=["price"])


def future_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Of the first fold's days what may be known in advance."""
    fold = fx.FOLDS["F1"]
    wide = _history(spark, sf).join(_inventory(spark, sf).drop("warehouse"), "unique_id").withColumns({"total_orders": F.lit(1.0), "availability": F.lit(1.0), "weight": F.lit(1.0)})
    first, last = Q.window_bounds(fold, fx.STEP)
    return _rounded(Q.future_covariates(wide.filter(F.col("date").between(F.lit(first), F.lit(last)))))


def submission_file(spark: SparkSession, sf: str) -> DataFrame:
    """The submission written as CSV and read back with its declared types; its ids are the template's."""
    folder = T.shared_folder(spark, "submission")
    sent, grid = submission(spark, sf), _grid(spark, sf)
    T.write_submission(sent, folder)
    back = T.read_csv(spark, folder, "solution")
    placed = back.join(sent.select("id", F.col("grid_order").alias("place")), "id")
    G.check_template(grid, placed)
    return _rounded(back)


def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The history written as CSV and read back, three of its columns only."""
    folder = T.shared_folder(spark, "sales-train")
    names = T.SCHEMAS["sales_train"].names
    full = _history(spark, sf).withColumns({"total_orders": F.lit(None).cast("double"), "availability": F.lit(1.0)})
    full.select(*names).write.option("header", True).option("dateFormat", "yyyy-MM-dd").csv(folder)
    back = T.read_csv(spark, folder, "sales_train", ("unique_id", "date", "sales"))
    return _rounded(back.groupBy("unique_id").agg(F.count("*").alias("rows"), F.count("sales").alias("known_rows"), F.min("date").alias("first"), F.max("date").alias("last"), F.sum("sales").alias("sales")))


def results_log(spark: SparkSession, sf: str) -> DataFrame:
    """Scores appended to an empty log in two runs, the first of them once more, read back, and averaged."""
    folder = T.shared_folder(spark, "results")
    scores = baseline_scores(spark, sf)
    text = {c: F.lit("") for c in ("timestamp", "git_hash", "change_description", "kept", "notes")}
    log = scores.select(F.col("baseline").alias("stage"), *[F.col(m).alias(f"local_{m}") for m in M.METRICS], F.col("place").cast("double").alias("runtime_minutes"), "fold").withColumns(text)
    for run, one in (("early", F.col("fold") < "F3"), ("late", F.col("fold") >= "F3"), ("early", F.col("fold") < "F3")):
        T.append_results(log.filter(one), folder, run)
    return _rounded(T.read_results(spark, folder).groupBy("stage").agg(*[F.avg(f"local_{m}").alias(f"local_{m}") for m in M.METRICS], F.sum("runtime_minutes").alias("runtime_minutes"), F.count("*").alias("rows")))


def run_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Summary of runs; a fold's scored rows stand in for its seconds."""
    runs = baseline_scores(spark, sf).withColumn("runtime_seconds", F.col("rows") / 10)
    return _rounded(M.run_summary(runs, ["baseline"]))


def blend_checked(spark: SparkSession, sf: str) -> DataFrame:
    """The 70/30 blend by a join that fails where the two sides haven't the same keys."""
    _, one, two = _pair(spark, sf)
    return _rounded(P.blend_frames(one, two, KEY, (0.7, 0.3), check="plan"))


def _weekend_rows(spark: SparkSession, sf: str) -> DataFrame:
    s = _split(spark, sf).labels.select("fold", "unique_id", "date", "horizon_day", "sales")
    return s.withColumn("weekend_flag", (F.weekday("date") >= 5).cast("int")).join(_inventory(spark, sf).select("unique_id", "warehouse"), "unique_id")


def _fitted(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.round(F.avg("sales_hat"), 3).alias("sales_hat"), (F.round(F.max("sales_hat") - F.min("sales_hat"), 3) + 0.0).alias("spread"))


def model_means(spark: SparkSession, sf: str) -> DataFrame:
    """Models that have one parameter for each group: at the optimum their predictions are the groups' means."""
    from ..operators import models

    rows = _weekend_rows(spark, sf).cache()
    parts = []
    for name in ("tweedie_1_1", "tweedie_1_3", "poisson"):
        model = models.fit_variant(rows, name, columns=["weekend_flag"], ridge=0.0)
        parts.append(_fitted(models.check_predictions(rows, models.predict(model, rows, models.VARIANTS[name].transform)), "weekend_flag").withColumn("model", F.lit(name)))
    # the first round of the trees fits means, with the warehouse's codes as categories
    codes = X.category_codes(_inventory(spark, sf), "warehouse").select(F.col("warehouse").alias("_w"), "code")
    coded = rows.join(codes, F.col("warehouse") == F.col("_w")).drop("warehouse", "_w").withColumnRenamed("code", "warehouse").cache()
    trees = models.fit_trees(coded, models.TreeConfig(rounds=1, least_rows=1), ["warehouse"], categorical=["warehouse"])
    parts.append(_fitted(models.predict(trees, coded), "warehouse").withColumnRenamed("warehouse", "weekend_flag").withColumn("model", F.lit("trees_by_warehouse")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("model", F.col("weekend_flag").cast("long").alias("group"), "rows", "sales_hat", "spread")


def model_by_horizon(spark: SparkSession, sf: str) -> DataFrame:
    """One model for each day of the horizon, each row by its own; group means as in ``model_means``."""
    from ..operators import models

    rows = _weekend_rows(spark, sf).cache()
    fitted = models.fit_by_horizon(rows, lambda day: models.fit_tweedie(day, 1.0, ["weekend_flag"], ridge=0.0))
    out = models.predict_by_horizon(fitted, rows)
    return _fitted(out, "horizon_day", "weekend_flag").select(F.col("horizon_day").cast("long").alias("horizon_day"), F.col("weekend_flag").cast("long").alias("group"), "rows", "sales_hat", "spread")


def model_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Tweedie trees with all nine categories, items and products included, trained and scored like ``tree_scores``."""
    return _boosted_scores(spark, sf, BO.BoostConfig("tweedie", 1.1, rounds=3, rate=0.5, least_rows=20), "trees_tweedie_categories")


BOOSTED = ("horizon_day", "weekday", "product_unique_id")


def _boost_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of all folds with a few columns of small whole numbers, items as they are numbered."""
    s = _split(spark, sf).labels.select(F.substring("fold", 2, 2).cast("int").alias("fold_number"), "unique_id", F.weekday("date").alias("weekday"), "horizon_day", "sales")
    return s.join(_inventory(spark, sf).select("unique_id", "product_unique_id"), "unique_id")


def _first_splits(spark: SparkSession, model, rows: DataFrame, by: str) -> DataFrame:
    """Each model's first split, with the predictions on both sides and their rows."""
    found = []
    for m, trees in model.trees.items():
        for tree in trees[:1]:
            left = None if tree.codes[0] is None else model.categories(tree, 0)
            threshold = model.threshold(tree, 0) if left is None else float(sum(left))
            found.append((m, round(model.start[m], 6), model.columns[tree.feature[0]], threshold, len(left or []), round(tree.gain[0], 6)))
    splits = spark.createDataFrame(found, f"{by} long, start double, feature string, threshold double, categories long, gain double")  # a row per model
    hats = BO.predict_boosted(model, rows).groupBy(F.col(by).cast("long").alias(by), F.round("sales_hat", 6).alias("sales_hat")).agg(F.count("*").alias("rows"))
    return hats.join(F.broadcast(splits), by)


#: One round of one split: what SQL can follow.
ONE_SPLIT = {"rounds": 1, "rate": 1.0, "leaves": 2, "least_rows": 20, "category_smooth": 3.0}


def boosted_split(spark: SparkSession, sf: str) -> DataFrame:
    """The first split and the two medians of an absolute-error model for each fold, all in the same passes."""
    rows = _boost_rows(spark, sf).cache()
    return _first_splits(spark, BO.fit_boosted(rows, BO.BoostConfig(**ONE_SPLIT), BOOSTED, by="fold_number"), rows, "fold_number")


def boosted_by_horizon(spark: SparkSession, sf: str) -> DataFrame:
    """The same for each day of the horizon: fourteen models in the same passes."""
    rows = _boost_rows(spark, sf).cache()
    return _first_splits(spark, BO.fit_boosted(rows, BO.BoostConfig(**ONE_SPLIT), BOOSTED[1:], by="horizon_day"), rows, "horizon_day")


def boosted_newton_split(spark: SparkSession, sf: str) -> DataFrame:
    """The first split and the two Newton steps of Poisson and Tweedie models."""
    rows = _boost_rows(spark, sf).withColumn("model", F.lit(0)).cache()
    out = None
    for name, objective, power in (("poisson", "poisson", 1.0), ("tweedie_1_1", "tweedie", 1.1), ("tweedie_1_3", "tweedie", 1.3)):
        model = BO.fit_boosted(rows, BO.BoostConfig(objective, power, **ONE_SPLIT), BOOSTED)
        one = _first_splits(spark, model, rows, "model").withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def boosted_category_split(spark: SparkSession, sf: str) -> DataFrame:
    """The first split of the items by the order of their gradients, for each fold."""
    rows = _boost_rows(spark, sf).cache()
    model = BO.fit_boosted(rows, BO.BoostConfig(**ONE_SPLIT), ["unique_id"], categorical=["unique_id"], by="fold_number")
    return _first_splits(spark, model, rows, "fold_number")


QUERIES: dict[str, Query] = {
    "fold_calendar": lambda spark, sf: _rounded(_folds(spark)),
    "official_grid": lambda spark, sf: _grid(spark, sf),
    "shifted_grid": lambda spark, sf: G.shift_grid(_grid(spark, sf), _folds(spark)),
    "history_cutoff": history_cutoff,
    "split_counters": lambda spark, sf: _rounded(_split(spark, sf).counters.drop("cutoff")),
    "disjoint_keys": disjoint_keys,
    **{f"baseline_{s}": _baseline(n) for s, n in zip(("zero", "global_median", "last", "same_weekday", "trail7", "trail14", "weekday_median"), B.BASELINES, strict=True)},
    "baseline_fallback_counts": lambda spark, sf: B.fallback_counts(predictions(spark, sf)),
    "baseline_scores": lambda spark, sf: _rounded(baseline_scores(spark, sf).drop("place")),
    "baseline_ranking": lambda spark, sf: _rounded(M.ranking(M.macro_average(baseline_scores(spark, sf), ["baseline", "place"])).drop("place")),
    "alignment_audit": alignment_audit,
    "feat_calendar": _features("day_of_week", "iso_week", "month", "weekend_flag", *CALENDAR_FLAGS),
    "feat_category_codes": _features("product_unique_id", "warehouse", *CATEGORIES),
    "feat_last_observed": _features("last_observed_sales", "last_observed_available"),
    "feat_trailing": _features("trailing_7_mean", "trailing_7_available", "trailing_14_mean", "trailing_14_available"),
    "feat_same_weekday": _features("same_weekday_sales", "same_weekday_direct_available"),
    "feat_history_stats": _features("historical_mean_sales", "historical_median_sales", "historical_stats_available", "observed_history_row_count"),
    "feat_price_stats": _features("price_relative_to_item_history_median", "price_relative_to_item_history_mean", "price_change_vs_last_observed", "discount_depth_relative_to_item_history"),
    "feat_price_rank": _features("price_rank_within_warehouse_date"),
    "feat_price_zscore": _features("price_zscore_vs_item_history"),
    "feat_discount_rowwise": _features("any_discount_active", "active_discount_count", "max_discount", "total_discount"),
    "feat_lags": _features(*X.STRONGER[:7]),
    "feat_rolling_medians": _features("rolling_7_median_sales", "rolling_14_median_sales", "rolling_28_median_sales", "rolling_28_mean_sales"),
    "feat_trend": _features("rolling_7_to_28_mean_ratio", "recent_trend_7_vs_28"),
    "feat_price_28d": _features("price_relative_to_28d_item_median", "price_relative_to_28d_item_mean", "price_change_vs_last_observed_price", "discount_change_vs_last_observed_total_discount"),
    "feat_group_l2": _features("warehouse_category_l2_mean_sales", "warehouse_category_l2_median_sales", "category_l2_mean_sales"),
    "feat_product": _features("product_mean_sales_across_warehouses", "product_median_sales_across_warehouses"),
    "feat_item_share": _features("item_share_of_warehouse_category_l2_sales"),
    "feat_interactions": _features("price_x_any_discount", "price_x_max_discount", "horizon_x_any_discount", "horizon_x_max_discount", "horizon_x_recent_trend_7_vs_28", "dayofweek_x_any_discount"),
    "feat_wh_cat_windows": _features(*X.PRESSURE[:5]),
    "feat_reversion": _features(*X.PRESSURE[5:8], *X.PRESSURE[12:]),
    "feat_item_share_windows": _features(*X.PRESSURE[8:12]),
    **{f"matrix{n}": _features(*cols) for n, cols in X.CONTRACTS.items()},
    "blend_fixed": lambda spark, sf: _rounded(_shifted_blend(spark, sf)),
    "clip_audit": lambda spark, sf: _rounded(P.clip_audit(_shifted_blend(spark, sf), ["fold"])),
    "target_transforms": target_transforms,
    "horizon_scores": lambda spark, sf: M.score(predictions(spark, sf, ("trailing_14_day_mean",)), ["horizon_day"]).select(
        F.col("horizon_day").cast("long").alias("horizon_day"), *[F.round(m, 6).alias(m) for m in M.METRICS], "rows"
    ),
    "best_variant_per_fold": lambda spark, sf: _rounded(M.best_per_fold(variant_scores(spark, sf), "variant")),
    "within_half_of_best": lambda spark, sf: _rounded(M.within_of_best(variant_scores(spark, sf)).select("fold", "variant", "wmae")),
    "decision_rule": lambda spark, sf: _rounded(M.decision(variant_scores(spark, sf), "variant", "control")),
    "suspicious_flag": suspicious_flag,
    "submission_frame": lambda spark, sf: _rounded(submission(spark, sf)),
    "submission_audit": lambda spark, sf: P.submission_audit(_grid(spark, sf), submission(spark, sf)),
    "prediction_summary": lambda spark, sf: _rounded(P.prediction_summary(submission(spark, sf))),
    "column_profile": lambda spark, sf: _rounded(
        profile(_history(spark, sf), ["unique_id", "sales", "sell_price_main", "type_0_discount", "type_4_discount"]).drop("float_error")
    ),
    "results_log_means": results_log_means,
    "ablation_checksums": ablation_checksums,
    "ablation_baselines": ablation_baselines,
    "newest_origin": lambda spark, sf: _rounded(X.latest_origin(features(spark, sf, ("trailing_14_mean", "horizon_day"))), 4),
    "horizon_counts": lambda spark, sf: _horizon_counts(spark, sf),
    "coercing_parse": coercing_parse,
    "gate_audit": gate_audit,
    "reproduced_scores": reproduced_scores,
    "frozen_counts": frozen_counts,
    "guard_counts": guard_counts,
    "missing_days": lambda spark, sf: Q.missing_days(_grid(spark, sf), fx.STEP),
    "future_columns": future_columns,
    "submission_file": submission_file,
    "csv_scan": csv_scan,
    "results_log": results_log,
    "run_totals": run_totals,
    "blend_checked": blend_checked,
    "model_means": model_means,
    "model_by_horizon": model_by_horizon,
    "model_categories": model_categories,
    "boosted_split": boosted_split,
    "boosted_by_horizon": boosted_by_horizon,
    "boosted_newton_split": boosted_newton_split,
    "boosted_category_split": boosted_category_split,
    "aligned_targets": aligned_targets,
    "dense_codes": dense_codes,
    "observed_guards": observed_guards,
    "report_lines": report_lines,
    "submission_order": submission_order,
    "unscorable_counts": unscorable_counts,
    "column_gaps": column_gaps,
    "training_rows": training_rows,
    "model_tweedie_scores": tweedie_scores,
    "model_tree_scores": tree_scores,
}
