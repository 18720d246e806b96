"""Hand-computed expectations on small frames."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import scalar as S
from tallyfold.operators import baselines as B
from tallyfold.operators import features as X
from tallyfold.operators import grid as G
from tallyfold.operators import guards as Q
from tallyfold.operators import metrics as M
from tallyfold.operators import predictions as P
from tallyfold.operators.profile import profile
from tallyfold.operators.split import split
from tallyfold.plans.queries import baseline_scores
from tallyfold.sources import fixtures as fx
from tallyfold.sources import tables as T
from tallyfold.sources.schema import CATEGORIES, DISCOUNTS, Availability

D = date(2024, 1, 1)
DISC = ", ".join(f"{c} double" for c in DISCOUNTS)


def day(n):
    return D + timedelta(days=n - 1)


def scored(spark, rows):
    return spark.createDataFrame(rows, "sales double, sales_hat double, weight double")


def history(spark, rows):
    """(id, day, sales[, price[, type_4]])"""
    full = [(r[0], day(r[1]), r[2], float(r[3]) if len(r) > 3 else 10.0, *[0.0] * 4, float(r[4]) if len(r) > 4 else 0.0, 0.0, 0.0) for r in rows]
    return spark.createDataFrame(full, f"unique_id int, date date, sales double, sell_price_main double, {DISC}")


def requests(spark, origin, rows):
    """(id, day, price, type_4)"""
    full = [(origin, r[0], day(r[1]), (day(r[1]) - origin).days, float(r[2]), *[0.0] * 4, float(r[3]), 0.0, 0.0) for r in rows]
    return spark.createDataFrame(full, f"origin date, unique_id int, date date, horizon_day int, sell_price_main double, {DISC}")


def inventory(spark, rows):
    """(id, product, warehouse, category)"""
    return spark.createDataFrame([(i, p, w, c, c, c, c) for i, p, w, c in rows], "unique_id int, product_unique_id int, warehouse string, " + ", ".join(f"{c} string" for c in CATEGORIES))


def calendar(spark):
    return spark.createDataFrame([(w, day(n), 0, 0, 0, 0) for w in ("W1", "W2") for n in range(1, 60)], "warehouse string, date date, holiday int, shops_closed int, winter_school_holidays int, school_holidays int")


# --- metrics


def test_metrics(spark):
    r = M.score(scored(spark, [(10.0, 12.0, 1.0), (20.0, 18.0, 2.0), (30.0, 24.0, 3.0)]), []).first()
    assert r.wmae == pytest.approx(4.0) and r.wape == pytest.approx(1 / 6) and r.bias == pytest.approx(-0.1) and r.rows == 3
    assert M.score(scored(spark, [(5.0, 6.0, 1.0), (5.0, 7.0, 1.0)]), []).first().bias == pytest.approx(0.3)


@pytest.mark.parametrize(
    "rows", [[], [(1.0, float("nan"), 1.0)], [(1.0, 1.0, -1.0)], [(1.0, 1.0, 0.0)], [(0.0, 1.0, 1.0)], [(1.0, 1.0, 1.0), (-1.0, 1.0, 1.0)], [(None, 1.0, 1.0)]]
)
def test_unscorable(spark, rows):
    with pytest.raises(Q.GuardError):
        M.check_scorable(scored(spark, rows))


# --- grid and folds


def grid_tables(spark):
    asked = spark.createDataFrame([(i, date(2024, 6, 3) + timedelta(days=d)) for i in (10, 20) for d in range(14)], "unique_id int, date date")
    return asked, spark.createDataFrame([(10, 1.0), (20, 3.0)], "unique_id int, weight double")


def test_grid(spark):
    asked, weights = grid_tables(spark)
    grid = G.build_grid(asked, weights, date(2024, 6, 2))
    rows = grid.orderBy("grid_order").collect()
    assert [r.grid_order for r in rows] == list(range(28)) and {(r.unique_id, r.weight) for r in rows} == {(10, 1.0), (20, 3.0)}
    folds = G.fold_calendar(spark, G.make_folds({"F": D}))
    moved = G.shift_grid(grid, folds).collect()
    assert {r.date for r in moved} == {day(n) for n in range(2, 16)} and len(moved) == 28
    with pytest.raises(Q.GuardError):
        G.build_grid(asked, weights.filter("unique_id = 10"), date(2024, 6, 2))
    with pytest.raises(Q.GuardError):
        G.build_grid(asked, weights, date(2024, 6, 1))
    ids = [f"{r.unique_id}_{r.test_date}" for r in rows]
    G.check_template(grid, spark.createDataFrame(list(enumerate(ids)), "place long, id string"))
    with pytest.raises(Q.GuardError):
        G.check_template(grid, spark.createDataFrame(list(enumerate(reversed(ids))), "place long, id string"))


def test_folds():
    assert G.make_folds({"A": D})[0].end == day(15)
    for bad in ({"A": D, "B": date(2024, 1, 10)}, {"A": D, "B": D}):
        with pytest.raises(Q.GuardError):
            G.make_folds(bad)
    assert fx.origins(date(2024, 6, 2))[0] == date(2024, 5, 19) and fx.origins(date(2024, 6, 2))[-1] == date(2023, 12, 17)


def test_alignment(spark):
    labels = spark.createDataFrame([(10, D, 10.0, 1.0), (20, D, 20.0, 3.0)], "unique_id int, date date, sales double, weight double")
    predicted = spark.createDataFrame([(20, D, 24.0), (10, D, 12.0)], "unique_id int, date date, sales_hat double")
    G.check_alignment(labels, predicted, ["unique_id", "date"])
    r = M.score(labels.join(predicted, ["unique_id", "date"]), []).first()
    assert (r.wmae, r.wape, r.bias) == (pytest.approx(14 / 4), pytest.approx(0.2), pytest.approx(0.2))
    with pytest.raises(Q.GuardError, match="missing=1"):
        G.check_alignment(labels, predicted.filter("unique_id = 10"), ["unique_id", "date"])
    with pytest.raises(Q.CardinalityError):
        G.check_alignment(labels, predicted.union(predicted), ["unique_id", "date"])


# --- guards


def test_guards(spark):
    h = history(spark, [(1, 1, 1.0), (1, 5, 1.0)])
    Q.check_history(h, day(5))
    with pytest.raises(Q.LeakageError):
        Q.check_history(h, day(4))
    assert Q.history_at(h, day(4)).count() == 1
    assert Q.window_bounds(D, 14) == (day(2), day(15))
    for bad in (0, -1, True, 1.5):
        with pytest.raises(ValueError):
            Q.window_bounds(D, bad)
    with pytest.raises(Q.LeakageError):
        Q.check_window(h, D, 3)
    with pytest.raises(Q.LeakageError):
        Q.check_sources(h, day(4), "date", "lag")
    with pytest.raises(Q.LeakageError):
        Q.check_no_target(h)
    with pytest.raises(Q.LeakageError):
        Q.check_disjoint(h, h.limit(1), ["unique_id", "date"])
    Q.check_disjoint(h, h.withColumn("unique_id", F.lit(2)), ["unique_id", "date"])
    with pytest.raises(Q.UnknownFieldError):
        Q.classify("nonsense")
    for bad in ("total_orders", "sales", "weight"):
        with pytest.raises(Q.GuardError):
            Q.check_future_columns([bad])
    assert Q.classify("sales") is Availability.TARGET
    assert Q.future_covariates(h).columns == ["unique_id", "date", "sell_price_main", *DISCOUNTS]
    with pytest.raises(Q.LeakageError):
        Q.check_request_fields(h)
    with pytest.raises(Q.CardinalityError):
        Q.join_to_one(h, h.select("unique_id", F.col("sales").alias("x")), ["unique_id"], "history")
    with pytest.raises(Q.GuardError):
        Q.check_finite(spark.createDataFrame([(float("inf"),)], "x double"), ["x"])


# --- splits and baselines


def small_split(spark):
    rows = [(i, d, None if (i, d) in {(1, 3), (2, 20)} else float(d)) for i in (1, 2) for d in range(1, 29) if (i, d) != (1, 22)]
    grid = spark.createDataFrame([(n, i, day(14 + h), h, 1.0) for n, (i, h) in enumerate((i, h) for i in (1, 2) for h in range(1, 15))], "grid_order long, unique_id int, test_date date, horizon_day int, weight double")
    return split(history(spark, rows), grid, G.fold_calendar(spark, G.make_folds({"F": day(14)})))


def test_split(spark):
    s = small_split(spark)
    c = s.counters.first()
    assert (c.requested_rows, c.scored_rows, c.missing_rows, c.excluded_rows) == (28, 26, 2, 1)
    assert not {"sales", "total_orders", "availability", "weight"} & set(s.requests.columns)


def test_baselines(spark):
    rows = [(1, d, float(d)) for d in range(1, 15)] + [(2, 14, 20.0)]
    asked = [(1, 15), (1, 22), (2, 15), (3, 15)]
    grid = spark.createDataFrame([(n, i, day(d), d - 14, 1.0) for n, (i, d) in enumerate(asked)], "grid_order long, unique_id int, test_date date, horizon_day int, weight double")
    folds = G.fold_calendar(spark, G.make_folds({"F": day(14)}))
    full = history(spark, rows + [(i, d, 1.0) for i, d in asked])
    s = split(full, grid, folds)
    got = {(r.baseline, r.unique_id, r.date): (r.sales_hat, r.far) for r in B.predict(B.context(s, folds)).collect()}
    assert got["same_weekday_last_week", 1, day(15)] == (8.0, 0)
    assert got["same_weekday_last_week", 1, day(22)] == (14.0, 1)
    assert got["same_weekday_last_week", 2, day(15)] == (20.0, 1)
    assert got["same_weekday_last_week", 3, day(15)] == (8.0, 2)
    assert got["trailing_7_day_mean", 1, day(15)] == (11.0, 0)
    assert got["trailing_7_day_mean", 3, day(15)] == (8.0, 2)
    assert got["trailing_14_day_mean", 1, day(15)] == (7.5, 0)
    assert got["zero_forecast", 1, day(15)] == (0.0, 0) and got["global_median", 1, day(15)] == (8.0, 0)
    assert got["last_observed_by_id", 3, day(15)] == (8.0, 2)
    assert got["median_by_id_day_of_week", 1, day(15)] == (4.5, 0)


@pytest.mark.parametrize("fold, rows, wmae, wape, bias", [("F1", 33, 17.259740, 0.629674, -0.243667), ("F4", 35, 16.649254, 0.617347, 0.130952)])
def test_minimum_slice(spark, sf, fold, rows, wmae, wape, bias):
    r = baseline_scores(spark, sf, ("trailing_14_day_mean",), holes=False).filter(F.col("fold") == fold).first()
    assert r.rows == rows and (round(r.wmae, 6), round(r.wape, 6), round(r.bias, 6)) == (wmae, wape, bias)


# --- features


def build(spark, rows, origin, asked, inv, columns):
    out = X.feature_matrix(history(spark, rows), requests(spark, origin, asked), inventory(spark, inv), calendar(spark), columns)
    return {(r.unique_id, r.date): r for r in out.collect()}


def test_base_and_price_features(spark):
    prices = [10, 12, 11, 13, 12, 14, 13, 15, 14, 16, 15, 17, 16, 18]
    rows = [(1, d, float(d), prices[d - 1]) for d in range(1, 15)]
    got = build(spark, rows, day(14), [(1, 15, 20, 0.0), (1, 22, 20, -0.1)], [(1, 7, "W1", "A")], X.CONTRACTS[46])
    a, b = got[1, day(15)], got[1, day(22)]
    assert a.trailing_7_mean == 11.0 and a.trailing_14_mean == 7.5 and a.horizon_day == 1 and b.horizon_day == 8
    assert (a.same_weekday_sales, a.same_weekday_direct_available) == (8.0, 1) and (b.same_weekday_sales, b.same_weekday_direct_available) == (14.0, 0)
    assert b.type_4_discount == -0.1 and b.any_discount_active == 0 and b.total_discount == pytest.approx(-0.1)
    assert a.price_relative_to_item_history_median == pytest.approx(20 / 14) and a.price_relative_to_item_history_mean == pytest.approx(20 / 14)
    assert a.price_change_vs_last_observed == pytest.approx(2) and a.price_rank_within_warehouse_date == 1.0
    assert a.warehouse == 0 and a.observed_history_row_count == 14


def test_stronger_features(spark):
    rows = [(1, d, float(d)) for d in range(1, 36)] + [(2, d, 100.0 + d) for d in range(1, 36)]
    got = build(spark, rows, day(35), [(1, 36, 10, 0.3), (1, 50, 10, 0.0)], [(1, 7, "W1", "A"), (2, 7, "W2", "A")], X.CONTRACTS[91])
    a, b = got[1, day(36)], got[1, day(50)]
    assert a.lag_7_sales == 29 and b.lag_7_sales == 35 and a.lag_14_sales == 22
    assert a.rolling_28_mean_sales == 21.5 and a.rolling_7_median_sales == 32 and a.rolling_14_median_sales == 28.5
    assert a.recent_trend_7_vs_28 == 10.5 and a.warehouse_category_l2_mean_sales == 18 and a.product_mean_sales_across_warehouses == 68
    assert a.item_share_of_warehouse_category_l2_sales == 1.0 and a.price_x_max_discount == pytest.approx(3.0)
    assert a.same_weekday_2w_sales == a.lag_14_sales and a.discount_active_count == a.active_discount_count == 1
    assert a.wh_cat_l2_reversion_pressure == pytest.approx(a.wh_cat_l2_7d_vs_28d_ratio - 1)


def test_pressure_features(spark):
    got = build(spark, [(1, 5, 10.0), (1, 9, 20.0), (2, 1, 5.0)], day(10), [(1, 11, 10, 0.0)], [(1, 7, "W1", "A"), (2, 8, "W1", "B")], X.PRESSURE)
    a = got[1, day(11)]
    assert a.wh_cat_l2_sales_7d_sum == 30 and a.wh_cat_l2_sales_7d_mean == 15 and a.item_share_of_wh_cat_l2_7d == 1.0


def test_contracts(spark):
    assert {n: len(c) for n, c in X.CONTRACTS.items()} == {36: 36, 46: 46, 76: 76, 91: 91}
    assert {k: len(v.columns) for k, v in X.ABLATIONS.items()} == {"A1": 28, "A2": 12, "A3": 7, "A4": 24, "A5": 36, "A6": 36, "A9": 0, "A10": 0}
    assert len(X.CATEGORICAL) == 9 and X.ABLATIONS["A6"].categorical == () and X.ABLATIONS["A5"].categorical == X.CATEGORICAL and X.ABLATIONS["A3"].categorical == X.BASE[:7]
    frame = spark.createDataFrame([tuple(range(37)), tuple(range(1, 38))], "origin int, " + ", ".join(f"{c} int" for c in X.BASE))
    assert X.ablation(frame, "A3").columns == list(X.ABLATIONS["A3"].columns)
    assert [r.unique_id for r in X.ablation(frame, "A5").collect()] == [2] and X.ablation(frame, "A6").count() == 2
    with pytest.raises(Q.GuardError):
        X.ablation(frame, "A9")
    with pytest.raises(Q.GuardError):
        X.ablation(frame.drop("warehouse"), "A3")


def test_median(spark):
    import random
    from statistics import median

    rng = random.Random(4)
    groups = {"a": [1.0, 2.0, 2.0, 9.0], "b": [3.0, 5.0], "c": [None], "d": [-7.5, -0.25], "e": [rng.gauss(0, 1) * 10 ** rng.randint(-3, 6) for _ in range(501)], "f": [1e6 + i / 7 for i in range(300)]}
    df = spark.createDataFrame([(k, x) for k, xs in groups.items() for x in xs], "k string, x double").groupBy("k", "x").agg(F.count("*").alias("_n"))
    assert {r.k: r.m for r in X.exact_median(df, ["k"], "x", "m").collect()} == {k: pytest.approx(median(xs), rel=1e-12) for k, xs in groups.items() if xs != [None]}


def test_order_of_the_contracts():
    assert X.PRICE[5:9] == ("any_discount_active", "max_discount", "total_discount", "active_discount_count")
    assert X.STRONGER[7:11] == ("rolling_7_median_sales", "rolling_14_median_sales", "rolling_28_mean_sales", "rolling_28_median_sales")
    assert X.CONTRACTS[46][36:] == X.PRICE and X.CONTRACTS[76][46:] == X.STRONGER and X.CONTRACTS[91][76:] == X.PRESSURE


def test_plans_fail_on_unmatched_rows(spark):
    asked, known = requests(spark, day(10), [(1, 11, 10, 0.0)]), history(spark, [(1, 5, 10.0)])
    inv, cal = inventory(spark, [(1, 7, "W1", "A")]), calendar(spark)
    assert X.feature_matrix(known, asked, inv, cal, X.BASE).count() == 1
    place = ("warehouse_category_l2_mean_sales",)
    for h, r, i, c, columns in (
        (known, asked, inv.limit(0), cal, X.BASE), (known, asked, inv, cal.filter("date <> '2024-01-11'"), X.BASE), (known, asked.withColumn("warehouse", F.lit("W2")), inv, cal, X.BASE),
        (known.unionByName(history(spark, [(9, 5, 1.0)])), asked, inv, cal, place),
    ):
        with pytest.raises(Exception, match="inventory|calendar"):
            X.feature_matrix(h, r, i, c, columns).collect()
    assert X.feature_matrix(known, asked.withColumn("warehouse", F.lit("W1")), inv, cal, X.BASE).count() == 1


def test_joins_check_their_cardinality(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, x string")
    right = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (None, 40), (None, 50)], "k int, y int")
    known = left.filter("k is not null")
    assert {(r.x, r.y) for r in Q.joined(known, right, ["k"], "t").collect()} == {("a", 10), ("b", 10), ("c", 20)}
    assert Q.joined(left, right, ["k"], "t", match="any").count() == 4  # nulls match nothing and are no copies
    fails = (
        (left, right, {}, "no match"), (known, right.unionByName(right.filter("k = 3")), {}, "several rows"), (known, right, {"how": "1:1"}, "several rows"),
        (known.filter("x <> 'b'"), right.filter("k is not null"), {"how": "1:1", "match": "both"}, "an extra row"),
    )
    for a, b, kind, said in fails:
        with pytest.raises(Exception, match=said):
            Q.joined(a, b, ["k"], "t", **kind).collect()
    with pytest.raises(ValueError):
        Q.joined(left, right, ["k"], "t", how="1:m")


def test_blend_fails_in_its_own_join(spark):
    a = spark.createDataFrame([(1, -4.0), (2, 4.0)], "k int, sales_hat double")
    assert P.blend_frames(a, a, ["k"], check="plan").count() == 2
    for bad in (a.limit(1), a.unionByName(a.limit(1)), a.withColumn("k", F.col("k") + 1)):
        with pytest.raises(Exception, match="blend"):
            P.blend_frames(a, bad, ["k"], check="plan").collect()


def test_training_targets_have_to_be_there(spark):
    from tallyfold.operators import models

    rows = spark.createDataFrame([(1, date(2024, 1, 1)), (2, date(2024, 1, 1))], "unique_id int, date date")
    labels = spark.createDataFrame([(1, date(2024, 1, 1), 3.0, 1.0), (2, date(2024, 1, 1), 4.0, 1.0)], "unique_id int, date date, sales double, weight double")
    assert models.aligned(rows, labels).count() == 2
    for bad in (labels.limit(1), labels.unionByName(labels), labels.withColumn("sales", F.when(F.col("unique_id") == 1, F.col("sales")))):
        with pytest.raises(Exception, match="training"):
            models.aligned(rows, bad).collect()
    inv = spark.createDataFrame([(1, 7)], "unique_id int, product_unique_id int")
    with pytest.raises(Exception, match="vocabulary"):
        models.item_codes(rows, inv, ["unique_id"]).collect()


def test_guards_ride_along(spark):
    rows = spark.createDataFrame([(date(2024, 1, d), float(d) if d != 5 else None) for d in range(1, 11)], "date date, price double")
    seen, verdict = Q.guarded(rows.repartition(3), Q.no_later_than(date(2024, 1, 8)), Q.finite("price"))
    sc = spark.sparkContext
    sc.setJobGroup("guards", "guards")
    seen.write.format("noop").mode("overwrite").save()
    with_guards = len(sc.statusTracker().getJobIdsForGroup("guards"))
    assert verdict.counts() == {"history": (2, date(2024, 1, 10)), "finite_price": (1, None)}
    assert len(sc.statusTracker().getJobIdsForGroup("guards")) == with_guards  # to ask takes no job
    sc.setJobGroup("plain", "plain")
    rows.repartition(3).write.format("noop").mode("overwrite").save()
    assert len(sc.statusTracker().getJobIdsForGroup("plain")) == with_guards
    sc.setLocalProperty("spark.jobGroup.id", None)
    with pytest.raises(Q.LeakageError, match="2 rows, the latest of 2024-01-10"):
        verdict.check()
    fine, verdict = Q.guarded(rows.filter("price is not null"), Q.within(date(2023, 12, 31), 14), Q.not_negative("price"))
    fine.count()
    fine.write.format("noop").mode("overwrite").save()
    verdict.check()


def test_shares_of_rank(spark):
    import random

    r = random.Random(4)
    rows = [(r.choice("ab"), r.choice([None, 0.0, 1.0, 1.5, 2.0, 1e6, -3.0])) for _ in range(60)] + [("c", 2.0), ("d", None)]
    got = {(x.k, x.x): x.share for x in X.shares_of_rank(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", "share").collect()}
    want = {}
    for k, x in rows:
        of = [v for j, v in rows if j == k and v is not None]
        if x is not None:
            want[k, x] = pytest.approx((sum(v < x for v in of) + (sum(v == x for v in of) + 1) / 2) / len(of))
    assert got == want


def test_codes_by_blocks(spark):
    words = [f"w{i % 50}" for i in range(200)] + [None, "", "Z", "é"]
    inv = spark.createDataFrame([(w, i % 37) for i, w in enumerate(words)], "w string, n int")
    for blocks in (1, 3, 64):
        bounds = X.vocabulary_bounds(inv, ["w", "n"], blocks)
        assert len(bounds["w"]) <= blocks
        assert {r.w: r.code for r in X.category_codes(inv, "w", bounds["w"]).collect()} == {w: i for i, w in enumerate(sorted({w for w in words if w is not None}))}
        assert {r.n: r.code for r in X.category_codes(inv, "n", bounds["n"]).collect()} == {n: n for n in range(37)}
    assert X.category_codes(inv.limit(0), "w").count() == 0


def test_gates_and_frozen_counts(spark):
    scores = spark.createDataFrame([("F1", 9.0, 0.3, -0.1, 5, 5, 29.0), ("F2", 10.0, 0.3, 0.0, 5, 5, 1.0), ("F3", 9.0, None, 0.0, 4, 5, 1.0)], "fold string, wmae double, wape double, bias double, rows int, wanted int, minutes double")
    judged = {r.fold: r for r in M.gates(scores, 10.0, 0.3, 0.1, "rows", "wanted", minutes=30).collect()}
    assert judged["F1"].passed and not judged["F2"].wmae_ok and not judged["F3"].wape_ok and not judged["F3"].rows_ok and judged["F3"].minutes_ok
    near = scores.withColumn("wmae", F.col("wmae") + 4e-10)
    assert [r.wmae_same for r in M.reproduced(scores, near, ["fold"]).collect()] == [True] * 3
    with pytest.raises(Q.GuardError):
        M.check_reproduced(scores, near, ["fold"], 1e-10)
    total = M.run_summary(scores, [], "minutes").first()
    assert (total.total_runtime, total.longest_runtime) == (31.0, 29.0)
    counters = spark.createDataFrame([("F1", 26, 26 / 28)], "fold string, scored_rows long, coverage double")
    frozen = lambda n, c: spark.createDataFrame([("F1", n, c)], "fold string, expected_rows long, expected_coverage double")
    Q.check_frozen(counters, frozen(26, 26 / 28), ["fold"])
    for n, c in ((27, 26 / 28), (26, 0.9)):
        with pytest.raises(Q.GuardError):
            Q.check_frozen(counters, frozen(n, c), ["fold"])


def test_horizon_models(spark):
    from tallyfold.operators import models

    rows = spark.createDataFrame([(h, float(i % 2), 2.0 * h + i % 2) for h in (1, 2, 3) for i in range(8)], "horizon_day int, x double, sales double")
    fitted = models.fit_by_horizon(rows, lambda day: models.fit_tweedie(day, 1.0, ["x"], ridge=0.0), range(1, 4))
    assert all(r.sales_hat == pytest.approx(r.sales, abs=1e-4) for r in models.predict_by_horizon(fitted, rows).collect())
    with pytest.raises(ValueError):
        models.predict_by_horizon({1: fitted[1]}, rows)
    sqrt = models.fit_variant(rows, "sqrt_l1", models.TreeConfig(rounds=1, least_rows=1), ["x", "horizon_day"])
    assert all(r.sales_hat == pytest.approx(r.sales, rel=1e-6) for r in models.predict(sqrt, rows, "sqrt").collect())
    with pytest.raises(Q.GuardError):
        models.check_predictions(rows, rows.withColumn("sales_hat", F.lit(float("nan"))))
    assert {r.conserved for r in models.horizon_counts(rows).collect()} == {True}
    assert {r.conserved for r in models.horizon_counts(rows.withColumn("horizon_day", F.col("horizon_day") + 12)).collect()} == {False}


def test_grid_order_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(G, "ITEM_BLOCK", 2)
    asked = spark.createDataFrame([(i, date(2024, 6, 2) + timedelta(days=d)) for i in (7, 2, 3, 11) for d in range(1, 15)], "unique_id int, date date")
    weights = spark.createDataFrame([(i, 1.0) for i in (2, 3, 7, 11)], "unique_id int, weight double")
    rows = G.build_grid(asked, weights, date(2024, 6, 2)).orderBy("grid_order").collect()
    assert [(r.grid_order, r.unique_id, r.horizon_day) for r in rows] == [(k, i, d) for k, (i, d) in enumerate((i, d) for i in (2, 3, 7, 11) for d in range(1, 15))]


# --- predictions


def test_blend(spark):
    a = spark.createDataFrame([(1, -4.0), (2, 4.0)], "k int, sales_hat double")
    b = spark.createDataFrame([(2, 6.0), (1, 2.0)], "k int, sales_hat double")
    both = P.blend_frames(a, b, ["k"])
    assert {r.k: (r.raw, r.sales_hat) for r in both.collect()} == {1: (-1.0, 0.0), 2: (5.0, 5.0)}
    audit = P.clip_audit(both, []).first()
    assert (audit.negative_rows, audit.clipped_rows) == (1, 1)
    with pytest.raises(Q.GuardError):
        P.blend_frames(a.withColumn("j", F.lit(1)), b.withColumn("j", F.lit(2)), ["j", "k"], check=True)
    with pytest.raises(ValueError):
        S.blend([F.lit(1), F.lit(2)], [0.2, 0.2])


def test_transforms(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (4.0,), (9.0,)], "y double")
    for how in ("raw", "sqrt", "log1p"):
        back = df.select("y", S.invert_target(S.transform_target(F.col("y"), how), how).alias("z")).collect()
        assert all(r.z == pytest.approx(r.y) for r in back)
    z = spark.createDataFrame([(-2.0,), (0.0,), (3.0,)], "z double")
    assert [r[0] for r in z.select(S.invert_target(F.col("z"), "sqrt", True)).collect()] == [0, 0, 9]
    assert [r[0] for r in z.select(S.invert_target(F.col("z"), "sqrt")).collect()] == [4, 0, 9]


def test_suspicious(spark):
    df = spark.createDataFrame([(100.0, 80.0), (100.0, 79.999), (100.0, 90.0)], "a double, b double")
    assert [r[0] for r in df.select(S.suspicious(F.col("a"), F.col("b"))).collect()] == [False, True, False]


def test_submission(spark, tmp_path):
    asked, weights = grid_tables(spark)
    grid = G.build_grid(asked, weights, date(2024, 6, 2)).cache()
    p = grid.select("unique_id", F.col("test_date").alias("date"), F.lit(1.5).alias("sales_hat"))
    sent = P.submission(grid, p)
    P.check_submission(grid, sent)
    turned = sent.withColumn("grid_order", 27 - F.col("grid_order"))
    for bad in (turned, sent.limit(27), sent.union(sent.limit(1)), sent.withColumn("sales_hat", F.lit(None).cast("double"))):
        with pytest.raises(Q.GuardError):
            P.check_submission(grid, bad)
    T.write_submission(sent, str(tmp_path / "out"))
    back = T.read_csv(spark, str(tmp_path / "out"), "solution").collect()
    assert back[0].id == "10_2024-06-03" and len(back) == 28


def test_results_log(spark, tmp_path):
    path = str(tmp_path / "log")
    row = [("t", "h", "s5", "c", 1.0, 2.0, 0.25, 3.0, "yes", "")]
    frame = spark.createDataFrame(row, T.RESULTS)
    T.append_results(frame.withColumn("local_wmae", F.lit(9.0)), path, "first")
    T.append_results(frame, path, "first")  # again: replaced, not added
    T.append_results(frame.withColumn("local_wmae", F.lit(3.0)), path, "second")
    with pytest.raises(ValueError):
        T.append_results(frame, path, "../first")
    log = T.read_results(spark, path)
    assert T.stage_means(log, ["s5"]).first().local_wmae == 2.0 and log.count() == 2
    assert "s5" in T.as_markdown(log) and '"stage"' in T.as_json(log)


def test_selection(spark):
    rows = [("F1", "control", 10.0), ("F1", "x", 9.8), ("F1", "y", 11.0), ("F2", "control", 8.0), ("F2", "x", 7.0), ("F2", "y", 7.9), ("F3", "control", 5.0), ("F3", "x", 4.0), ("F3", "y", 5.2)]
    s = spark.createDataFrame(rows, "fold string, variant string, wmae double")
    assert {r.fold: r.best for r in M.best_per_fold(s, "variant").collect()} == {"F1": "x", "F2": "x", "F3": "x"}
    assert {(r.fold, r.variant) for r in M.within_of_best(s).collect()} == {("F1", "x"), ("F1", "control"), ("F2", "x"), ("F3", "x")}
    assert {r.variant: r.decision for r in M.decision(s, "variant", "control").collect()} == {"x": "supported", "y": "rejected"}


def test_profile(spark):
    df = spark.createDataFrame([(1, -3.0, 0.1, None), (300, 4.0, 1e9 + 0.123, None)], "a int, b double, c double, d double")
    got = {r["column"]: r.kind for r in profile(df, ["a", "b", "c", "d"]).collect()}
    assert got == {"a": "uint16", "b": "int8", "c": "float32", "d": "uint8"}


def test_the_inventory_reads_no_line_once_the_history_is_kept(spark, sf):
    """Both come from the same kept sums, so the lines are read, joined and summed up once."""
    from tallyfold.plans import queries as plans
    from tallyfold.sources import fixtures

    spark.catalog.clearCache()
    plans._history(spark, sf)
    leaves = fixtures.inventory(spark, sf)._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert {leaves.apply(i).getClass().getSimpleName() for i in range(leaves.size())} == {"InMemoryRelation"}
