"""The queries of ``plans.queries`` as DuckDB SQL."""

from __future__ import annotations

from ..operators.baselines import BASELINES
from ..operators.features import BASE, CONTRACTS, LAGS
from ..sources.fixtures import FINAL, FOLDS, NEW_ITEM, STEP
from ..sources.schema import CALENDAR_FLAGS, CATEGORIES, DISCOUNTS

_DISC = ", ".join(DISCOUNTS)
_SUM = " + ".join(DISCOUNTS)
_ACTIVE = " + ".join(f"CAST({c} > 0 AS INT)" for c in DISCOUNTS)

_FOLD_ROWS = ", ".join(f"('{n}', DATE '{d}')" for n, d in FOLDS.items())

#: The projection of the supplied tables into the domain.
DOMAIN = f"""
fx_line AS (
  SELECT CAST(substr(p_brand, 7) AS INT) AS product_unique_id, CAST(r_regionkey AS INT) AS rk, r_name AS warehouse,
    CAST(l_shipdate AS DATE) AS date, l_quantity, CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS cents, l_discount, l_linenumber
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
fx_full AS (
  SELECT CAST(product_unique_id * 10 + rk AS INT) AS unique_id, date, MIN(warehouse) AS warehouse, SUM(l_quantity) AS sales,
    CAST(SUM(cents) AS DOUBLE) / (SUM(l_quantity) * 100) AS sell_price_main,
    {", ".join(f"COALESCE(MAX(CASE WHEN l_linenumber = {i + 1} THEN {'-' if i == 4 else ''}l_discount END), 0.0) AS {c}" for i, c in enumerate(DISCOUNTS))}
  FROM fx_line GROUP BY 1, 2),
history AS (
  SELECT * REPLACE (CASE WHEN (unique_id + day(date)) % 97 = 0 THEN NULL ELSE sales END AS sales) FROM fx_full
  WHERE NOT (unique_id = {NEW_ITEM} AND date <= DATE '{FOLDS["F4"]}')),
inventory AS (
  SELECT CAST(product_unique_id * 10 + rk AS INT) AS unique_id, MIN(product_unique_id) AS product_unique_id, MIN(warehouse) AS warehouse,
    {", ".join(f"concat('L{i}_', CAST(MIN(product_unique_id) % {m} AS VARCHAR)) AS L{i}_category_name_en" for i, m in ((1, 3), (2, 5), (3, 7), (4, 4)))}
  FROM fx_line GROUP BY 1),
folds AS (SELECT * FROM (VALUES {_FOLD_ROWS}) AS t(fold, cutoff)),
days AS (SELECT CAST(unnest(range(1, {STEP + 1})) AS INT) AS horizon_day),
grid AS (
  SELECT ROW_NUMBER() OVER (ORDER BY i.unique_id, horizon_day) - 1 AS grid_order, i.unique_id, CAST(DATE '{FINAL}' + horizon_day AS DATE) AS test_date, horizon_day,
    CAST(1 + i.unique_id % 7 AS DOUBLE) / 2 AS weight
  FROM inventory i, days WHERE (i.unique_id + horizon_day) % 13 <> 0),
shifted AS (
  SELECT fold, cutoff, grid_order, unique_id, CAST(cutoff + horizon_day AS DATE) AS date, horizon_day, weight FROM grid, folds),
joined AS (
  SELECT s.*, h.sales, h.sell_price_main, {", ".join("h." + c for c in DISCOUNTS)} FROM shifted s LEFT JOIN history h USING (unique_id, date)),
labels AS (SELECT * FROM joined WHERE sales IS NOT NULL),
known AS (SELECT * FROM history WHERE sales IS NOT NULL)"""

#: Everything that the baselines predict from, and their predictions in long form.
BASE_LINES = f"""
seen AS (SELECT f.cutoff, k.unique_id, k.date, k.sales FROM known k JOIN folds f ON k.date <= f.cutoff),
item AS (
  SELECT cutoff, unique_id, max_by(sales, date) AS last, AVG(CASE WHEN date > cutoff - 7 THEN sales END) AS mean_7,
    AVG(CASE WHEN date > cutoff - 14 THEN sales END) AS mean_14 FROM seen GROUP BY 1, 2),
overall AS (SELECT cutoff, median(sales) AS overall FROM seen GROUP BY 1),
wd AS (SELECT cutoff, unique_id, isodow(date) AS d, median(sales) AS weekday_median FROM seen GROUP BY 1, 2, 3),
ctx AS (
  SELECT l.fold, l.unique_id, l.date, l.horizon_day, l.sales, l.weight, overall, last, mean_7, mean_14, weekday_median,
    CASE WHEN l.date - 7 <= l.cutoff THEN k.sales END AS week_ago
  FROM labels l LEFT JOIN overall o USING (cutoff) LEFT JOIN item i ON i.cutoff = l.cutoff AND i.unique_id = l.unique_id
  LEFT JOIN wd ON wd.cutoff = l.cutoff AND wd.unique_id = l.unique_id AND wd.d = isodow(l.date)
  LEFT JOIN known k ON k.unique_id = l.unique_id AND k.date = l.date - 7),
long AS (
  {" UNION ALL ".join(
    f"SELECT fold, '{name}' AS baseline, {i} AS place, unique_id, date, horizon_day, sales, weight, {value} AS sales_hat, {far} AS far FROM ctx"
    for i, (name, value, far) in enumerate(
      (b, *(("0.0", "0") if b == "zero_forecast" else ("overall", "0") if b == "global_median" else
        (f"COALESCE({c}, last, overall)", f"CASE WHEN {c} IS NOT NULL THEN 0 WHEN last IS NOT NULL THEN 1 ELSE 2 END")))
      for b, c in zip(BASELINES, ("", "", "last", "week_ago", "mean_7", "mean_14", "weekday_median"))))}),
scores AS (
  SELECT fold, baseline, MIN(place) AS place, SUM(weight * ABS(sales - sales_hat)) / SUM(weight) AS wmae, SUM(ABS(sales - sales_hat)) / SUM(ABS(sales)) AS wape,
    SUM(sales_hat - sales) / SUM(sales) AS bias, COUNT(*) AS rows FROM long GROUP BY 1, 2)"""


def _in(d: int, x: str = "sales") -> str:
    return f"CASE WHEN date > origin - {d} THEN {x} END"


def _ratio(a: str, b: str, other: str) -> str:
    return f"COALESCE(({a}) / NULLIF({b}, 0), {other})"


_CAL = "CAST(day(r.date) = 1 AS INT), CAST(month(r.date) = 1 AND day(r.date) = 1 AS INT), CAST(month(r.date) IN (1, 2) AS INT), CAST(month(r.date) IN (7, 8) AS INT)".split("), ")
_CAL = [x if x.endswith(")") else x + ")" for x in _CAL]

#: All features of the scored requests of the folds.
FEATURES = f"""
req AS (SELECT cutoff AS origin, unique_id, date, horizon_day, sell_price_main, {_DISC} FROM labels),
fseen AS (
  SELECT f.cutoff AS origin, k.unique_id, k.date, k.sales, k.sell_price_main AS price, {_SUM.replace("type", "k.type")} AS disc
  FROM known k JOIN folds f ON k.date <= f.cutoff),
fall AS (
  SELECT origin, median(sales) AS all_median, AVG(price) AS all_price_mean, median(price) AS all_price_median, stddev_pop(price) AS all_price_std,
    AVG(disc) AS all_off_mean, max_by(disc, (date, unique_id)) AS all_off_last FROM fseen GROUP BY 1),
fitem AS (
  SELECT origin, unique_id, max_by(sales, date) AS last, AVG(sales) AS mean, median(sales) AS median, COUNT(sales) AS n, SUM(sales) AS sum,
    SUM({_in(7)}) AS sum_7, SUM({_in(28)}) AS sum_28, {", ".join(f"AVG({_in(d)}) AS mean_{d}, median({_in(d)}) AS median_{d}" for d in (7, 14, 28))},
    AVG(price) AS price_mean, median(price) AS price_median, stddev_samp(price) AS price_std, max_by(price, date) AS price_last, AVG(disc) AS off_mean,
    AVG({_in(28, "price")}) AS price_mean_28, median({_in(28, "price")}) AS price_median_28, max_by(price, {_in(28, "date")}) AS price_last_28,
    max_by(disc, {_in(28, "date")}) AS off_last_28
  FROM fseen GROUP BY 1, 2),
fnamed AS (SELECT s.*, i.product_unique_id, i.warehouse, i.{CATEGORIES[1]} AS l2 FROM fseen s JOIN inventory i USING (unique_id)),
fplace AS (
  SELECT origin, warehouse, l2, AVG(sales) AS place_mean, median(sales) AS place_median, SUM(sales) AS place_sum,
    {", ".join(f"SUM({_in(d)}) AS group_{d}" for d in (7, 14, 28))}, COUNT(DISTINCT {_in(7, "date")}) AS days_7, COUNT(DISTINCT {_in(28, "date")}) AS days_28
  FROM fnamed GROUP BY 1, 2, 3),
fproduct AS (SELECT origin, product_unique_id, AVG(sales) AS product_mean, median(sales) AS product_median FROM fnamed GROUP BY 1, 2),
fl2 AS (SELECT origin, l2, AVG(sales) AS l2_mean FROM fnamed GROUP BY 1, 2),
f1 AS (
  SELECT r.*, i.product_unique_id, i.warehouse, {", ".join("i." + c for c in CATEGORIES)}, a.* EXCLUDE (origin), t.* EXCLUDE (origin, unique_id),
    p.* EXCLUDE (origin, warehouse, l2), q.product_mean, q.product_median, z.l2_mean,
    {", ".join(f"CASE WHEN r.date - {k} <= r.origin THEN h{k}.sales END AS back_{k}" for k in LAGS)},
    {", ".join(f"{x} AS {c}" for x, c in zip(_CAL, CALENDAR_FLAGS))}
  FROM req r LEFT JOIN inventory i ON i.unique_id = r.unique_id LEFT JOIN fall a ON a.origin = r.origin
  LEFT JOIN fitem t ON t.origin = r.origin AND t.unique_id = r.unique_id
  LEFT JOIN fplace p ON p.origin = r.origin AND p.warehouse = i.warehouse AND p.l2 = i.{CATEGORIES[1]}
  LEFT JOIN fproduct q ON q.origin = r.origin AND q.product_unique_id = i.product_unique_id
  LEFT JOIN fl2 z ON z.origin = r.origin AND z.l2 = i.{CATEGORIES[1]}
  {" ".join(f"LEFT JOIN known h{k} ON h{k}.unique_id = r.unique_id AND h{k}.date = r.date - {k}" for k in LAGS)}),
f2 AS (
  SELECT *, isodow(date) - 1 AS day_of_week, week(date) AS iso_week, month(date) AS month, CAST(isodow(date) >= 6 AS INT) AS weekend_flag,
    COALESCE(last, all_median) AS last_observed_sales, CAST(last IS NOT NULL AS INT) AS last_observed_available,
    CAST({_ACTIVE} > 0 AS INT) AS any_discount_active, {_ACTIVE} AS active_discount_count, GREATEST({_DISC}) AS max_discount, {_SUM} AS total_discount
  FROM f1),
f3 AS (
  SELECT *, COALESCE(mean_7, last_observed_sales) AS trailing_7_mean, CAST(mean_7 IS NOT NULL AS INT) AS trailing_7_available,
    COALESCE(mean_14, last_observed_sales) AS trailing_14_mean, CAST(mean_14 IS NOT NULL AS INT) AS trailing_14_available,
    COALESCE(back_7, last_observed_sales) AS same_weekday_sales, CAST(back_7 IS NOT NULL AS INT) AS same_weekday_direct_available,
    COALESCE(mean, last_observed_sales) AS historical_mean_sales, COALESCE(median, last_observed_sales) AS historical_median_sales,
    CAST(mean IS NOT NULL AS INT) AS historical_stats_available, COALESCE(n, 0) AS observed_history_row_count,
    {_ratio("sell_price_main", "COALESCE(price_median, all_price_median)", "1.0")} AS price_relative_to_item_history_median,
    {_ratio("sell_price_main", "COALESCE(price_mean, all_price_mean)", "1.0")} AS price_relative_to_item_history_mean,
    sell_price_main - COALESCE(price_last, all_price_median) AS price_change_vs_last_observed,
    (RANK() OVER (PARTITION BY origin, warehouse, date ORDER BY sell_price_main)
      + (COUNT(*) OVER (PARTITION BY origin, warehouse, date, sell_price_main) - 1) / 2.0) / COUNT(*) OVER (PARTITION BY origin, warehouse, date)
      AS price_rank_within_warehouse_date,
    {_ratio("sell_price_main - COALESCE(price_mean, all_price_mean)", "COALESCE(price_std, CASE WHEN all_price_std > 0 THEN all_price_std END, 1.0)", "0.0")}
      AS price_zscore_vs_item_history,
    {_ratio("total_discount", "COALESCE(off_mean, all_off_mean)", "1.0")} AS discount_depth_relative_to_item_history
  FROM f2),
f4 AS (
  SELECT *, same_weekday_sales AS lag_7_sales, {", ".join(f"COALESCE(back_{k}, same_weekday_sales) AS lag_{k}_sales, COALESCE(back_{k}, same_weekday_sales) AS same_weekday_{k // 7}w_sales" for k in LAGS[1:])},
    {", ".join(f"COALESCE(median_{d}, historical_median_sales) AS rolling_{d}_median_sales" for d in (7, 14, 28))},
    COALESCE(mean_28, historical_mean_sales) AS rolling_28_mean_sales,
    {_ratio("sell_price_main", "COALESCE(price_median_28, all_price_median)", "1.0")} AS price_relative_to_28d_item_median,
    {_ratio("sell_price_main", "COALESCE(price_mean_28, all_price_mean)", "1.0")} AS price_relative_to_28d_item_mean,
    sell_price_main - COALESCE(price_last_28, all_price_median) AS price_change_vs_last_observed_price,
    active_discount_count AS discount_active_count,
    total_discount - COALESCE(off_last_28, all_off_last) AS discount_change_vs_last_observed_total_discount,
    sell_price_main * any_discount_active AS price_x_any_discount, sell_price_main * max_discount AS price_x_max_discount,
    COALESCE(place_mean, historical_mean_sales) AS warehouse_category_l2_mean_sales,
    COALESCE(place_median, historical_median_sales) AS warehouse_category_l2_median_sales,
    COALESCE(product_mean, historical_mean_sales) AS product_mean_sales_across_warehouses,
    COALESCE(product_median, historical_median_sales) AS product_median_sales_across_warehouses,
    COALESCE(l2_mean, historical_mean_sales) AS category_l2_mean_sales,
    {_ratio("COALESCE(sum, 0.0)", "COALESCE(place_sum, 0.0)", "0.0")} AS item_share_of_warehouse_category_l2_sales,
    horizon_day * any_discount_active AS horizon_x_any_discount, horizon_day * max_discount AS horizon_x_max_discount,
    day_of_week * any_discount_active AS dayofweek_x_any_discount,
    {", ".join(f"COALESCE(group_{d}, historical_mean_sales * {d}) AS wh_cat_l2_sales_{d}d_sum" for d in (7, 14, 28))},
    {", ".join(f"COALESCE(group_{d} / NULLIF(days_{d}, 0), historical_mean_sales) AS wh_cat_l2_sales_{d}d_mean" for d in (7, 28))},
    {", ".join(_ratio(f"COALESCE(sum_{d}, 0.0)", f"COALESCE(group_{d}, 0.0)", "0.0") + f" AS item_share_of_wh_cat_l2_{d}d" for d in (7, 28))}
  FROM f3),
f5 AS (
  SELECT *, {_ratio("trailing_7_mean", "rolling_28_mean_sales", "1.0")} AS rolling_7_to_28_mean_ratio,
    trailing_7_mean - rolling_28_mean_sales AS recent_trend_7_vs_28,
    {_ratio("wh_cat_l2_sales_7d_mean", "wh_cat_l2_sales_28d_mean", "1.0")} AS wh_cat_l2_7d_vs_28d_ratio,
    wh_cat_l2_sales_7d_mean - wh_cat_l2_sales_28d_mean AS wh_cat_l2_7d_minus_28d_mean,
    COALESCE(wh_cat_l2_sales_7d_mean / NULLIF(wh_cat_l2_sales_28d_mean, 0) - 1, 0.0) AS wh_cat_l2_reversion_pressure,
    item_share_of_wh_cat_l2_7d - item_share_of_wh_cat_l2_28d AS item_share_7d_minus_28d,
    {_ratio("item_share_of_wh_cat_l2_7d", "item_share_of_wh_cat_l2_28d", "1.0")} AS item_share_7d_to_28d_ratio
  FROM f4),
feat AS (
  SELECT *, horizon_day * recent_trend_7_vs_28 AS horizon_x_recent_trend_7_vs_28,
    horizon_day * wh_cat_l2_reversion_pressure AS horizon_x_wh_cat_l2_reversion_pressure,
    any_discount_active * wh_cat_l2_reversion_pressure AS discount_x_wh_cat_l2_reversion_pressure,
    price_relative_to_28d_item_median * wh_cat_l2_reversion_pressure AS relative_price_x_wh_cat_l2_reversion_pressure
  FROM f5)"""

#: Moves exact decimal ties off the rounding boundary, where the last bit of a sum would decide.
NUDGE = 3e-8

INT_FEATURES = {
    "unique_id", "product_unique_id", "horizon_day", "day_of_week", "iso_week", "month", "weekend_flag", *CALENDAR_FLAGS, "last_observed_available",
    "trailing_7_available", "trailing_14_available", "same_weekday_direct_available", "historical_stats_available", "observed_history_row_count",
    "any_discount_active", "active_discount_count", "discount_active_count", "horizon_x_any_discount", "dayofweek_x_any_discount", "warehouse", *CATEGORIES,
}


def _select(columns) -> str:
    out = []
    for c in columns:
        if c in ("warehouse", *CATEGORIES):
            out.append(f"(SELECT CAST(COUNT(DISTINCT v.{c}) AS BIGINT) FROM inventory v WHERE v.{c} < feat.{c}) AS {c}")
        elif c in INT_FEATURES:
            out.append(f"CAST({c} AS BIGINT) AS {c}")
        else:
            out.append(f"ROUND({c} + {NUDGE:.8f}, 4) AS {c}")
    return ", ".join(out)


def feature_sql(columns) -> str:
    more = [c for c in columns if c != "unique_id"]
    return f"WITH {DOMAIN}, {FEATURES} SELECT origin, unique_id, date, {_select(more)} FROM feat"


def _with(body: str, select: str) -> str:
    return f"WITH {DOMAIN}{', ' + body if body else ''} {select}"


_BLEND = """
pair AS (
  SELECT a.fold, a.unique_id, a.date, a.horizon_day, a.sales, a.weight, a.sales_hat AS a, b.sales_hat AS b
  FROM long a JOIN long b ON a.fold = b.fold AND a.unique_id = b.unique_id AND a.date = b.date
  WHERE a.baseline = 'trailing_14_day_mean' AND b.baseline = 'median_by_id_day_of_week'),
variants AS (
  SELECT fold, unique_id, date, sales, weight, 'control' AS variant, a AS sales_hat FROM pair UNION ALL
  SELECT fold, unique_id, date, sales, weight, 'other', b FROM pair UNION ALL
  SELECT fold, unique_id, date, sales, weight, 'blend_70_30', 0.7 * a + 0.3 * b FROM pair UNION ALL
  SELECT fold, unique_id, date, sales, weight, 'blend_50_50', 0.5 * a + 0.5 * b FROM pair),
vscores AS (
  SELECT fold, variant, SUM(weight * ABS(sales - sales_hat)) / SUM(weight) AS wmae FROM variants GROUP BY 1, 2)"""

_FINAL = f"""
fin AS (
  SELECT unique_id, max_by(sales, date) AS last, AVG(CASE WHEN date > DATE '{FINAL}' - 14 THEN sales END) AS mean_14 FROM known
  WHERE date <= DATE '{FINAL}' GROUP BY 1),
sub AS (
  SELECT g.grid_order, concat(CAST(g.unique_id AS VARCHAR), '_', strftime(g.test_date, '%Y-%m-%d')) AS id,
    GREATEST(COALESCE(mean_14, last, (SELECT median(sales) FROM known WHERE date <= DATE '{FINAL}')), 0.0) AS sales_hat
  FROM grid g LEFT JOIN fin USING (unique_id))"""

_ROUNDED = "ROUND(wmae, 6) AS wmae, ROUND(wape, 6) AS wape, ROUND(bias, 6) AS bias"
_PROFILED = ("unique_id", "sales", "sell_price_main", "type_0_discount", "type_4_discount")


def _profile(c: str) -> str:
    return f"""SELECT '{c}' AS "column", COUNT(*) AS rows, COUNT({c}) AS known, COUNT(DISTINCT {c}) AS different, CAST(MIN({c}) AS DOUBLE) AS low,
      CAST(MAX({c}) AS DOUBLE) AS high, COALESCE(BOOL_AND({c} = ROUND({c})), TRUE) AS whole,
      MAX(ABS({c} - CAST(CAST({c} AS FLOAT) AS DOUBLE)) / GREATEST(ABS({c}), 1.0)) <= 1e-6 AS float_safe FROM history"""


# Columns of the ablations, by what they are made of.
_OF_ITEM = "unique_id product_unique_id warehouse L1_category_name_en L2_category_name_en L3_category_name_en L4_category_name_en".split()
_OF_DAY = "horizon_day day_of_week iso_week month weekend_flag holiday shops_closed winter_school_holidays school_holidays".split()
_OF_PRICE = ["sell_price_main", *(f"type_{i}_discount" for i in range(7))]
_OF_PAST = (
    "last_observed_sales last_observed_available trailing_7_mean trailing_7_available trailing_14_mean trailing_14_available same_weekday_sales "
    "same_weekday_direct_available historical_mean_sales historical_median_sales historical_stats_available observed_history_row_count"
).split()
_ABLATED = {
    "A1": (_OF_ITEM + _OF_DAY + _OF_PAST, 9), "A2": (_OF_PAST, 0), "A3": (_OF_ITEM, 7), "A4": (_OF_ITEM + _OF_DAY + _OF_PRICE, 9),
    "A5": (_OF_ITEM + _OF_DAY + _OF_PRICE + _OF_PAST, 9), "A6": (_OF_ITEM + _OF_DAY + _OF_PRICE + _OF_PAST, 0),
}


def _codes(c: str) -> str:
    return f"(SELECT COUNT(DISTINCT v.{c}) FROM inventory v WHERE v.{c} < feat.{c})" if c in ("warehouse", *CATEGORIES) else c


def _ablated(name: str, columns: list[str], categories: int) -> str:
    cells = " + ".join(f"CAST({c} AS DOUBLE)" for c in columns)
    newest = " WHERE origin = (SELECT MAX(origin) FROM cells)" if name == "A5" else ""
    return f"SELECT '{name}' AS ablation, CAST({len(columns)} AS BIGINT) AS columns, CAST({categories} AS BIGINT) AS categories, COUNT(*) AS rows, ROUND(SUM({cells}), 2) AS cells FROM cells{newest}"


_GATES = (("wmae_ok", "wmae < 17.5"), ("wape_ok", "wape <= 0.62"), ("bias_ok", "ABS(bias) <= 0.1"), ("rows_ok", "rows = (SELECT COUNT(*) FROM labels l WHERE l.fold = scores.fold)"), ("place_ok", "place < 6"))
_WEEKEND = """
wk AS (SELECT l.fold, l.horizon_day, l.sales, CAST(isodow(l.date) >= 6 AS BIGINT) AS g, (SELECT COUNT(DISTINCT v.warehouse) FROM inventory v WHERE v.warehouse < i.warehouse) AS w
  FROM labels l JOIN inventory i USING (unique_id))"""




def _first_split(model: str, name: str, columns: tuple[str, ...], start: str, g: str, h: str, leaf: str, hat: str) -> str:
    """The best split of one round over small whole numbers, by model; ``y``, ``s``, ``g``, ``h`` are a row's target, start, slope and curvature."""
    each = " UNION ALL ".join(f"SELECT m, {i} AS f, '{c}' AS feature, CAST({c} AS DOUBLE) AS x, y, s, g, h FROM sloped" for i, c in enumerate(columns))
    return f"""
boost AS (
  SELECT CAST(substr(l.fold, 2) AS INT) AS fold_number, l.unique_id, isodow(l.date) - 1 AS weekday, l.horizon_day, i.product_unique_id, l.sales AS y
  FROM labels l JOIN inventory i USING (unique_id)),
begun AS (SELECT *, CAST({model} AS BIGINT) AS m, {start} OVER (PARTITION BY {model}) AS s0 FROM boost),
started AS (SELECT *, {"s0" if hat == "v" else "LN(s0)"} AS s FROM begun),
sloped AS (SELECT *, {g} AS g, {h} AS h FROM started),
each AS ({each}),
everywhere AS (SELECT f, x, LEAD(x) OVER (PARTITION BY f ORDER BY x) AS next FROM (SELECT DISTINCT f, x FROM each)),
summed AS (SELECT m, f, feature, x, SUM(g) AS g, SUM(h) AS h, COUNT(*) AS n FROM each GROUP BY ALL),
run AS (
  SELECT m, f, feature, x, SUM(g) OVER u AS gl, SUM(h) OVER u AS hl, SUM(n) OVER u AS nl, SUM(g) OVER a AS gt, SUM(h) OVER a AS ht, SUM(n) OVER a AS nt
  FROM summed WINDOW u AS (PARTITION BY m, f ORDER BY x), a AS (PARTITION BY m, f)),
gains AS (
  SELECT *, gl * gl / hl + (gt - gl) * (gt - gl) / (ht - hl) - gt * gt / ht AS gain FROM run WHERE nl >= 20 AND nt - nl >= 20),
best AS (
  SELECT m, feature, g.f, g.x, gain, (g.x + next) / 2 AS threshold FROM gains g JOIN everywhere e ON e.f = g.f AND e.x = g.x WHERE gain > 1e-12
  QUALIFY ROW_NUMBER() OVER (PARTITION BY m ORDER BY ROUND(gain, 7) DESC, g.f, g.x) = 1),
sides AS (SELECT e.m, e.s, b.feature, b.threshold, b.gain, e.x <= b.threshold AS on_left, COUNT(*) AS n, {leaf} AS v FROM each e JOIN best b ON b.m = e.m AND b.f = e.f GROUP BY ALL),
split_rows AS (
  SELECT m AS {name}, ROUND(s, 6) AS start, feature, threshold, CAST(0 AS BIGINT) AS categories, ROUND(gain, 6) AS gain, ROUND({"s + v" if hat == "v" else "EXP(s + v)"}, 6) AS sales_hat, CAST(SUM(n) AS BIGINT) AS rows
  FROM sides GROUP BY ALL)"""


_WANTED = {
    "lineitem": ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_shipdate", "l_extendedprice", "l_absent"),
    "part": ("p_partkey", "p_brand", "p_absent"), "supplier": ("s_suppkey", "s_nationkey"),
}


def _gaps(table: str, wanted: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{c}'" for c in wanted)
    known = f"(SELECT name, n FROM (SELECT * FROM (SELECT COUNT(COLUMNS(*)) FROM {table}) UNPIVOT (n FOR name IN (COLUMNS(*)))))"
    return f"""SELECT '{table}' AS "table", name AS "column", 'extra' AS kind, n AS known FROM {known} k WHERE name NOT IN ({listed})
      UNION ALL SELECT '{table}', w, 'missing', 0 FROM (SELECT unnest([{listed}]) AS w) t WHERE w NOT IN (SELECT name FROM {known} k)"""


_BOOSTED = ("horizon_day", "weekday", "product_unique_id")
_L1 = ("median(y)", "CAST(SIGN(s - y) AS DOUBLE)", "CAST(1 AS DOUBLE)", "median(e.y - e.s)", "v")
_TWEEDIE = "EXP({b} * s) - y * EXP({a} * s)", "{b} * EXP({b} * s) - {a} * y * EXP({a} * s)"


def _newton(name: str, g: str, h: str) -> str:
    body = _first_split("0", "model", _BOOSTED, "AVG(y)", g, h, "-SUM(e.g) / SUM(e.h)", "exp(v)")
    return f"(WITH {DOMAIN}, {body} SELECT * REPLACE ('{name}' AS model) FROM split_rows)"


_ITEM_SPLIT = """
boost AS (SELECT CAST(substr(fold, 2) AS INT) AS m, unique_id AS x, sales AS y, median(sales) OVER (PARTITION BY fold) AS s FROM labels),
summed AS (SELECT m, x, CAST(SUM(SIGN(s - y)) AS DOUBLE) AS g, COUNT(*) AS n FROM boost GROUP BY 1, 2),
ranked AS (
  SELECT *, SUM(g) OVER (PARTITION BY m) AS gt, SUM(n) OVER (PARTITION BY m) AS nt, g / (n + 3) AS ratio FROM summed),
used AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY m ORDER BY ratio, x) AS up, ROW_NUMBER() OVER (PARTITION BY m ORDER BY ratio DESC, x DESC) AS down FROM ranked WHERE n >= 3),
ways AS (SELECT *, 0 AS way, up AS place FROM used UNION ALL SELECT *, 1, down FROM used),
run AS (SELECT *, SUM(g) OVER u AS gl, SUM(n) OVER u AS nl FROM ways WHERE place <= 32 WINDOW u AS (PARTITION BY m, way ORDER BY place)),
best AS (
  SELECT *, gl * gl / (nl + 10) + (gt - gl) * (gt - gl) / (nt - nl + 10) - gt * gt / nt AS gain FROM run WHERE nl >= 20 AND nt - nl >= 20
  QUALIFY ROW_NUMBER() OVER (PARTITION BY m ORDER BY ROUND(gain, 7) DESC, way, place) = 1),
chosen AS (SELECT b.m, b.gain, w.x, b.place FROM best b JOIN ways w ON w.m = b.m AND w.way = b.way AND w.place <= b.place),
told AS (SELECT m, gain, COUNT(*) AS categories, CAST(SUM(x) AS DOUBLE) AS threshold FROM chosen GROUP BY 1, 2),
sides AS (SELECT b.m, b.s, c.x IS NOT NULL AS on_left, COUNT(*) AS n, median(b.y - b.s) AS v FROM boost b LEFT JOIN chosen c ON c.m = b.m AND c.x = b.x GROUP BY ALL)"""


SQL: dict[str, str] = {
    "fold_calendar": _with("", f"SELECT fold, cutoff, CAST(cutoff + 1 AS DATE) AS start, CAST(cutoff + {STEP} AS DATE) AS \"end\", CAST({STEP} AS BIGINT) AS horizon FROM folds"),
    "official_grid": _with("", "SELECT CAST(grid_order AS BIGINT) AS grid_order, unique_id, test_date, horizon_day, weight FROM grid"),
    "shifted_grid": _with("", "SELECT fold, cutoff, CAST(grid_order AS BIGINT) AS grid_order, unique_id, date, horizon_day, weight FROM shifted"),
    "history_cutoff": _with("", "SELECT fold, COUNT(*) AS rows, COUNT(sales) AS known_rows, MAX(date) AS latest, ROUND(SUM(sales), 6) AS sales FROM history JOIN folds ON date <= cutoff GROUP BY 1"),
    "split_counters": _with("", """SELECT j.fold, requested_rows, scored_rows, missing_rows, history_rows, excluded_rows, ROUND(scored_rows / requested_rows, 6) AS coverage FROM
      (SELECT fold, COUNT(*) AS requested_rows, COUNT(sales) AS scored_rows, COUNT(*) - COUNT(sales) AS missing_rows FROM joined GROUP BY 1) j JOIN
      (SELECT fold, COUNT(sales) AS history_rows, COUNT(*) - COUNT(sales) AS excluded_rows FROM history JOIN folds ON date <= cutoff GROUP BY 1) h ON h.fold = j.fold"""),
    "disjoint_keys": _with("", """SELECT fold, (SELECT COUNT(*) FROM labels l JOIN known k USING (unique_id, date) WHERE l.fold = folds.fold AND k.date <= folds.cutoff) AS shared,
      (SELECT COUNT(*) FROM labels l JOIN known k USING (unique_id, date) WHERE l.fold = folds.fold) AS shared_with_all FROM folds"""),
    **{
        f"baseline_{short}": _with(BASE_LINES, f"SELECT fold, unique_id, date, ROUND(sales_hat, 6) AS sales_hat, CAST(far AS BIGINT) AS far FROM long WHERE baseline = '{name}'")
        for short, name in zip(("zero", "global_median", "last", "same_weekday", "trail7", "trail14", "weekday_median"), BASELINES)
    },
    "baseline_fallback_counts": _with(BASE_LINES, """SELECT fold, baseline, COUNT(*) AS rows, COUNT(CASE WHEN far >= 1 THEN 1 END) AS primary_fallback_rows,
      COUNT(CASE WHEN far = 2 THEN 1 END) AS global_fallback_rows FROM long GROUP BY 1, 2"""),
    "baseline_scores": _with(BASE_LINES, f"SELECT fold, baseline, {_ROUNDED}, rows FROM scores"),
    "baseline_ranking": _with(BASE_LINES, """SELECT baseline, ROUND(mean_wmae, 6) AS mean_wmae, ROUND(mean_wape, 6) AS mean_wape, ROUND(mean_bias, 6) AS mean_bias, folds, rows,
      ROW_NUMBER() OVER (ORDER BY mean_wmae, place) AS rank FROM (SELECT baseline, MIN(place) AS place, AVG(wmae) AS mean_wmae, AVG(wape) AS mean_wape, AVG(bias) AS mean_bias,
      COUNT(*) AS folds, CAST(SUM(rows) AS BIGINT) AS rows FROM scores GROUP BY 1) t"""),
    "alignment_audit": _with(BASE_LINES, """SELECT COALESCE(l.fold, p.fold) AS fold, COUNT(CASE WHEN l.fold IS NOT NULL AND p.fold IS NOT NULL THEN 1 END) AS matched,
      COUNT(CASE WHEN p.fold IS NULL THEN 1 END) AS missing, COUNT(CASE WHEN l.fold IS NULL THEN 1 END) AS extra FROM (SELECT fold, unique_id, date FROM labels) l FULL OUTER JOIN
      (SELECT fold, CASE WHEN (unique_id + horizon_day) % 19 = 1 THEN -unique_id ELSE unique_id END AS unique_id, date FROM long
       WHERE baseline = 'zero_forecast' AND (unique_id + horizon_day) % 17 <> 0) p ON l.fold = p.fold AND l.unique_id = p.unique_id AND l.date = p.date GROUP BY 1"""),
    "feat_calendar": feature_sql(("day_of_week", "iso_week", "month", "weekend_flag", *CALENDAR_FLAGS)),
    "feat_category_codes": feature_sql(("product_unique_id", "warehouse", *CATEGORIES)),
    "feat_last_observed": feature_sql(("last_observed_sales", "last_observed_available")),
    "feat_trailing": feature_sql(("trailing_7_mean", "trailing_7_available", "trailing_14_mean", "trailing_14_available")),
    "feat_same_weekday": feature_sql(("same_weekday_sales", "same_weekday_direct_available")),
    "feat_history_stats": feature_sql(("historical_mean_sales", "historical_median_sales", "historical_stats_available", "observed_history_row_count")),
    "feat_price_stats": feature_sql(("price_relative_to_item_history_median", "price_relative_to_item_history_mean", "price_change_vs_last_observed", "discount_depth_relative_to_item_history")),
    "feat_price_rank": feature_sql(("price_rank_within_warehouse_date",)),
    "feat_price_zscore": feature_sql(("price_zscore_vs_item_history",)),
    "feat_discount_rowwise": feature_sql(("any_discount_active", "active_discount_count", "max_discount", "total_discount")),
    "feat_lags": feature_sql(("lag_7_sales", "lag_14_sales", "lag_21_sales", "lag_28_sales", "same_weekday_2w_sales", "same_weekday_3w_sales", "same_weekday_4w_sales")),
    "feat_rolling_medians": feature_sql(("rolling_7_median_sales", "rolling_14_median_sales", "rolling_28_median_sales", "rolling_28_mean_sales")),
    "feat_trend": feature_sql(("rolling_7_to_28_mean_ratio", "recent_trend_7_vs_28")),
    "feat_price_28d": feature_sql(("price_relative_to_28d_item_median", "price_relative_to_28d_item_mean", "price_change_vs_last_observed_price", "discount_change_vs_last_observed_total_discount")),
    "feat_group_l2": feature_sql(("warehouse_category_l2_mean_sales", "warehouse_category_l2_median_sales", "category_l2_mean_sales")),
    "feat_product": feature_sql(("product_mean_sales_across_warehouses", "product_median_sales_across_warehouses")),
    "feat_item_share": feature_sql(("item_share_of_warehouse_category_l2_sales",)),
    "feat_interactions": feature_sql(("price_x_any_discount", "price_x_max_discount", "horizon_x_any_discount", "horizon_x_max_discount", "horizon_x_recent_trend_7_vs_28", "dayofweek_x_any_discount")),
    "feat_wh_cat_windows": feature_sql(("wh_cat_l2_sales_7d_sum", "wh_cat_l2_sales_14d_sum", "wh_cat_l2_sales_28d_sum", "wh_cat_l2_sales_7d_mean", "wh_cat_l2_sales_28d_mean")),
    "feat_reversion": feature_sql(("wh_cat_l2_7d_vs_28d_ratio", "wh_cat_l2_7d_minus_28d_mean", "wh_cat_l2_reversion_pressure", "horizon_x_wh_cat_l2_reversion_pressure", "discount_x_wh_cat_l2_reversion_pressure", "relative_price_x_wh_cat_l2_reversion_pressure")),
    "feat_item_share_windows": feature_sql(("item_share_of_wh_cat_l2_7d", "item_share_of_wh_cat_l2_28d", "item_share_7d_minus_28d", "item_share_7d_to_28d_ratio")),
    **{f"matrix{n}": feature_sql(CONTRACTS[n]) for n in (36, 46, 76, 91)},
    "blend_fixed": _with(f"{BASE_LINES}, {_BLEND}", "SELECT fold, unique_id, date, ROUND(0.5 * (a - 20) + 0.5 * (b - 20), 6) AS raw, ROUND(GREATEST(0.5 * (a - 20) + 0.5 * (b - 20), 0.0), 6) AS sales_hat FROM pair"),
    "clip_audit": _with(f"{BASE_LINES}, {_BLEND}", """SELECT fold, COUNT(*) AS rows, COUNT(CASE WHEN r < 0 THEN 1 END) AS negative_rows, COUNT(CASE WHEN r < 0 THEN 1 END) AS clipped_rows,
      ROUND(MIN(r), 6) AS lowest FROM (SELECT fold, 0.5 * (a - 20) + 0.5 * (b - 20) AS r FROM pair) t GROUP BY 1"""),
    "target_transforms": _with("", """SELECT fold, ROUND(SUM(y), 4) AS raw, ROUND(SUM(sqrt(GREATEST(y, 0))), 4) AS root, ROUND(SUM(ln(1 + GREATEST(y, 0))), 4) AS log1p,
      ROUND(SUM(pow(sqrt(GREATEST(y, 0)), 2)), 4) AS root_back, ROUND(SUM(exp(ln(1 + GREATEST(y, 0))) - 1), 4) AS log1p_back, ROUND(SUM(y * y), 4) AS square_unclipped,
      ROUND(SUM(GREATEST(y, 0) * GREATEST(y, 0)), 4) AS square_clipped, COUNT(CASE WHEN y < 0 THEN 1 END) AS negative_rows FROM (SELECT fold, sales - 20 AS y FROM labels) t GROUP BY 1"""),
    "horizon_scores": _with(BASE_LINES, f"""SELECT CAST(horizon_day AS BIGINT) AS horizon_day, {_ROUNDED}, rows FROM (SELECT horizon_day, SUM(weight * ABS(sales - sales_hat)) / SUM(weight) AS wmae,
      SUM(ABS(sales - sales_hat)) / SUM(ABS(sales)) AS wape, SUM(sales_hat - sales) / SUM(sales) AS bias, COUNT(*) AS rows FROM long WHERE baseline = 'trailing_14_day_mean' GROUP BY 1) t"""),
    "best_variant_per_fold": _with(f"{BASE_LINES}, {_BLEND}", "SELECT fold, min_by(variant, (wmae, variant)) AS best, ROUND(MIN(wmae), 6) AS best_wmae FROM vscores GROUP BY 1"),
    "within_half_of_best": _with(f"{BASE_LINES}, {_BLEND}", """SELECT fold, variant, ROUND(wmae, 6) AS wmae FROM (SELECT *, MIN(wmae) OVER (PARTITION BY fold) AS best FROM vscores) t WHERE wmae <= best + 0.5"""),
    "decision_rule": _with(f"{BASE_LINES}, {_BLEND}", """SELECT variant, ROUND(m, 6) AS mean_wmae, ROUND(c, 6) AS control_mean, won AS folds_won,
      CASE WHEN m < c AND won >= 3 THEN 'supported' WHEN m < c THEN 'inconclusive' ELSE 'rejected' END AS decision FROM
      (SELECT v.variant, AVG(v.wmae) AS m, AVG(k.wmae) AS c, COUNT(CASE WHEN v.wmae < k.wmae THEN 1 END) AS won FROM vscores v JOIN vscores k ON k.fold = v.fold AND k.variant = 'control'
       WHERE v.variant <> 'control' GROUP BY 1) t"""),
    "suspicious_flag": _with(BASE_LINES, """SELECT s.fold, s.baseline, (z.wmae - s.wmae) / z.wmae > 0.2 AS suspicious FROM scores s JOIN scores z ON z.fold = s.fold AND z.baseline = 'zero_forecast'"""),
    "submission_frame": _with(_FINAL, "SELECT CAST(grid_order AS BIGINT) AS grid_order, id, ROUND(sales_hat, 6) AS sales_hat FROM sub"),
    "submission_audit": _with(_FINAL, """SELECT (SELECT COUNT(*) FROM grid) AS grid_rows, COUNT(*) AS rows, COUNT(*) - COUNT(DISTINCT id) AS duplicates, COUNT(*) - COUNT(sales_hat) AS null_rows,
      COUNT(CASE WHEN sales_hat < 0 THEN 1 END) AS negative_rows, (SELECT COUNT(*) FROM grid g FULL OUTER JOIN sub s ON s.grid_order = g.grid_order
        WHERE concat(CAST(g.unique_id AS VARCHAR), '_', CAST(g.test_date AS VARCHAR)) IS DISTINCT FROM s.id) AS misplaced FROM sub"""),
    "prediction_summary": _with(_FINAL, """SELECT COUNT(*) AS rows, ROUND(MIN(sales_hat), 6) AS low, ROUND(MAX(sales_hat), 6) AS high, ROUND(AVG(sales_hat), 6) AS mean, ROUND(median(sales_hat), 6) AS median,
      COUNT(CASE WHEN sales_hat < 0 THEN 1 END) AS negative_rows, COUNT(*) - COUNT(sales_hat) AS null_rows FROM sub"""),
    "column_profile": _with("", f"""SELECT "column", rows, known, different, ROUND(low, 6) AS low, ROUND(high, 6) AS high, whole, float_safe,
      CASE WHEN whole AND low >= 0 AND high <= 255 THEN 'uint8' WHEN whole AND low >= 0 AND high <= 65535 THEN 'uint16' WHEN whole AND low >= 0 AND high <= 4294967295 THEN 'uint32'
        WHEN whole AND low >= 0 THEN 'uint64' WHEN whole AND low >= -128 AND high <= 127 THEN 'int8' WHEN whole AND low >= -32768 AND high <= 32767 THEN 'int16'
        WHEN whole AND low >= -2147483648 AND high <= 2147483647 THEN 'int32' WHEN whole THEN 'int64' WHEN float_safe THEN 'float32' ELSE 'float64' END AS kind,
      different / rows <= 0.1 AS encode FROM ({" UNION ALL ".join(_profile(c) for c in _PROFILED)}) t"""),
    "results_log_means": _with(BASE_LINES, """SELECT baseline AS stage, ROUND(AVG(wmae), 6) AS local_wmae, ROUND(AVG(wape), 6) AS local_wape, ROUND(AVG(bias), 6) AS local_bias, COUNT(*) AS rows
      FROM scores WHERE baseline IN ('trailing_7_day_mean', 'trailing_14_day_mean') GROUP BY 1"""),
    "ablation_checksums": f"WITH {DOMAIN}, {FEATURES}, cells AS (SELECT origin, {', '.join(f'{_codes(c)} AS {c}' for c in _ABLATED['A6'][0])} FROM feat) "
      + " UNION ALL ".join(_ablated(n, *v) for n, v in _ABLATED.items()),
    "ablation_baselines": _with(BASE_LINES, f"SELECT CASE baseline WHEN 'trailing_14_day_mean' THEN 'A9' ELSE 'A10' END AS ablation, {_ROUNDED}, rows FROM scores WHERE fold = 'F1' AND baseline IN ('trailing_14_day_mean', 'median_by_id_day_of_week')"),
    "newest_origin": f"WITH {DOMAIN}, {FEATURES} SELECT origin, unique_id, date, ROUND(trailing_14_mean, 4) AS trailing_14_mean, horizon_day FROM feat WHERE origin = (SELECT MAX(cutoff) FROM folds)",
    "horizon_counts": _with("", "SELECT CAST(horizon_day AS BIGINT) AS horizon_day, COUNT(*) AS rows, (SELECT COUNT(*) FROM labels WHERE horizon_day BETWEEN 1 AND 14) = (SELECT COUNT(*) FROM labels) AS conserved FROM labels GROUP BY 1"),
    "coercing_parse": """SELECT o_orderpriority, COUNT(*) AS rows, COUNT(d) AS days, MIN(d) AS earliest, MAX(d) AS latest, COUNT(x) AS numbers, ROUND(SUM(x), 2) AS total FROM (
      SELECT o_orderpriority, TRY_CAST(CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' WHEN o_orderkey % 11 = 0 THEN '2001-13-45' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS DATE) AS d,
        CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 6 <> 0 AND o_orderkey % 9 <> 0 THEN ROUND(o_totalprice, 2) END AS x FROM orders) t GROUP BY 1""",
    "gate_audit": _with(BASE_LINES, f"SELECT fold, baseline, {', '.join(f'{e} AS {n}' for n, e in _GATES)}, {' AND '.join(f'({e})' for _, e in _GATES)} AS passed FROM scores"),
    "reproduced_scores": _with(BASE_LINES, """SELECT c.fold, r.baseline AS reference, ABS(c.wmae - r.wmae) <= 5e-10 AS wmae_same, ABS(c.wape - r.wape) <= 5e-10 AS wape_same, ABS(c.bias - r.bias) <= 5e-10 AS bias_same
      FROM scores c JOIN scores r ON c.fold = r.fold WHERE c.baseline = 'trailing_14_day_mean' AND r.baseline IN ('trailing_14_day_mean', 'median_by_id_day_of_week')"""),
    "frozen_counts": _with("", """SELECT fold, COUNT(sales) AS scored_rows, COUNT(sales) + CASE WHEN fold = 'F4' THEN 1 ELSE 0 END AS expected_rows, fold <> 'F4' AS rows_match, TRUE AS coverage_match FROM joined GROUP BY 1"""),
    "guard_counts": _with("""moved AS (
      SELECT fold, cutoff, unique_id, CAST(date + 3 AS DATE) AS date, CASE WHEN unique_id % 4 <> 0 THEN sell_price_main END AS price, k FROM labels, (VALUES (1), (2)) t(k) WHERE k = 1 OR unique_id % 5 = 0
      UNION ALL SELECT fold, cutoff, unique_id, CAST(date - 10 AS DATE), sell_price_main, 3 FROM labels WHERE unique_id % 3 = 0)""", """SELECT fold, COUNT(CASE WHEN date <= cutoff THEN 1 END) AS before, COUNT(CASE WHEN date > cutoff AND date <= cutoff + 14 THEN 1 END) AS inside,
      COUNT(CASE WHEN date > cutoff + 14 THEN 1 END) AS after, COUNT(CASE WHEN (SELECT COUNT(*) FROM moved o WHERE o.fold = moved.fold AND o.unique_id = moved.unique_id AND o.date = moved.date) > 1 THEN 1 END) AS repeated,
      COUNT(*) - COUNT(price) AS bad_price FROM moved GROUP BY 1"""),
    "missing_days": _with("", """SELECT i.unique_id, COUNT(g.unique_id) AS days, COALESCE(string_agg(CASE WHEN g.unique_id IS NULL THEN CAST(d.horizon_day AS VARCHAR) END, ',' ORDER BY d.horizon_day), '') AS missing
      FROM (SELECT DISTINCT unique_id FROM grid) i CROSS JOIN days d LEFT JOIN grid g ON g.unique_id = i.unique_id AND g.horizon_day = d.horizon_day GROUP BY 1"""),
    "future_columns": _with("", f"SELECT h.unique_id, date, h.warehouse, ROUND(sell_price_main, 6) AS sell_price_main, {', '.join(f'ROUND({c}, 6) AS {c}' for c in DISCOUNTS)}, CAST(i.product_unique_id AS BIGINT) AS product_unique_id, {', '.join('i.' + c for c in CATEGORIES)} FROM history h JOIN inventory i ON i.unique_id = h.unique_id WHERE date > DATE '{FOLDS['F1']}' AND date <= DATE '{FOLDS['F1']}' + 14"),
    "submission_file": _with(_FINAL, "SELECT id, ROUND(sales_hat, 6) AS sales_hat FROM sub"),
    "csv_scan": _with("", 'SELECT unique_id, COUNT(*) AS rows, COUNT(sales) AS known_rows, MIN(date) AS "first", MAX(date) AS "last", ROUND(SUM(sales), 6) AS sales FROM history GROUP BY 1'),
    "results_log": _with(BASE_LINES, "SELECT baseline AS stage, ROUND(AVG(wmae), 6) AS local_wmae, ROUND(AVG(wape), 6) AS local_wape, ROUND(AVG(bias), 6) AS local_bias, CAST(SUM(place) AS DOUBLE) AS runtime_minutes, COUNT(*) AS rows FROM scores GROUP BY 1"),
    "run_totals": _with(BASE_LINES, """SELECT baseline, ROUND(AVG(wmae), 6) AS mean_wmae, ROUND(AVG(wape), 6) AS mean_wape, ROUND(AVG(bias), 6) AS mean_bias, ROUND(SUM(rows / 10), 6) AS total_runtime, ROUND(AVG(rows / 10), 6) AS mean_runtime,
      ROUND(MAX(rows / 10), 6) AS longest_runtime FROM scores GROUP BY 1"""),
    "blend_checked": _with(f"{BASE_LINES}, {_BLEND}", "SELECT fold, unique_id, date, ROUND(0.7 * a + 0.3 * b, 6) AS raw, ROUND(GREATEST(0.7 * a + 0.3 * b, 0.0), 6) AS sales_hat FROM pair"),
    "model_means": _with(_WEEKEND, " UNION ALL ".join(
      f"SELECT '{m}' AS model, CAST({g} AS BIGINT) AS \"group\", COUNT(*) AS rows, ROUND(AVG(sales), 3) AS sales_hat, CAST(0.0 AS DOUBLE) AS spread FROM wk GROUP BY 2"
      for m, g in (("tweedie_1_1", "g"), ("tweedie_1_3", "g"), ("poisson", "g"), ("trees_by_warehouse", "w")))),
    "model_by_horizon": _with(_WEEKEND, 'SELECT CAST(horizon_day AS BIGINT) AS horizon_day, g AS "group", COUNT(*) AS rows, ROUND(AVG(sales), 3) AS sales_hat, CAST(0.0 AS DOUBLE) AS spread FROM wk GROUP BY 1, 2'),
    "boosted_split": _with(_first_split("fold_number", "fold_number", _BOOSTED, *_L1), "SELECT * FROM split_rows"),
    "boosted_by_horizon": _with(_first_split("horizon_day", "horizon_day", _BOOSTED[1:], *_L1), "SELECT * FROM split_rows"),
    "boosted_newton_split": " UNION ALL ".join([_newton("poisson", "EXP(s) - y", "EXP(s + 0.7)")] + [
      _newton(f"tweedie_1_{p}", *[e.format(a=f"(-0.{p})", b=f"0.{10 - p}") for e in _TWEEDIE]) for p in (1, 3)]),
    "boosted_category_split": _with(_ITEM_SPLIT, """SELECT CAST(s.m AS BIGINT) AS fold_number, ROUND(s, 6) AS start, 'unique_id' AS feature, threshold, categories, ROUND(gain, 6) AS gain, ROUND(s + v, 6) AS sales_hat,
      CAST(SUM(n) AS BIGINT) AS rows FROM sides s JOIN told t ON t.m = s.m GROUP BY ALL"""),
    "aligned_targets": _with("", f"""SELECT CAST(o.origin AS DATE) AS origin, COUNT(*) AS rows, ROUND(SUM(k.sales), 6) AS sales, ROUND(SUM(k.sales * g.horizon_day), 6) AS moment, ROUND(SUM(k.sell_price_main), 4) AS prices FROM
      (SELECT CAST(DATE '{FOLDS["F1"]}' - CAST(14 * i AS INT) AS DATE) AS origin FROM range(0, 13) r(i)) o, grid g JOIN known k ON k.unique_id = g.unique_id AND k.date = CAST(o.origin + g.horizon_day AS DATE) GROUP BY 1"""),
    "dense_codes": _with("", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(v AS VARCHAR) AS value, ROW_NUMBER() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT {c} AS v FROM inventory)" for c in ("unique_id", "product_unique_id", CATEGORIES[1]))),
    "observed_guards": _with("""moved AS (
      SELECT cutoff, CAST(date + 3 AS DATE) AS date, CAST(date - 7 AS DATE) AS source, CASE WHEN unique_id % 4 <> 0 THEN sell_price_main - CASE WHEN unique_id % 5 = 0 THEN 1e9 ELSE 0.0 END END AS price FROM labels)""",
      """SELECT 'history' AS guard, COUNT(*) AS rows, CAST(MAX(date) AS VARCHAR) AS latest FROM moved WHERE date > cutoff
      UNION ALL SELECT 'window', COUNT(*), CAST(MAX(date) AS VARCHAR) FROM moved WHERE date <= cutoff OR date > cutoff + 14
      UNION ALL SELECT 'source', COUNT(*), CAST(MAX(source) AS VARCHAR) FROM moved WHERE source > cutoff
      UNION ALL SELECT 'finite_price', COUNT(*), NULL FROM moved WHERE price IS NULL UNION ALL SELECT 'not_negative_price', COUNT(*), NULL FROM moved WHERE price IS NULL OR price < 0"""),
    "report_lines": _with(BASE_LINES, """SELECT 0 AS line, '| baseline | wmae | wape | bias |' AS text UNION ALL SELECT 1, '|---|---|---|---|' UNION ALL
      SELECT 1 + ROW_NUMBER() OVER (ORDER BY wmae, baseline), printf('| %s | %.6f | %.6f | %.6f |', baseline, wmae, wape, bias) FROM (SELECT baseline, AVG(wmae) AS wmae, AVG(wape) AS wape, AVG(bias) AS bias FROM scores GROUP BY 1)"""),
    "submission_order": _with(_FINAL, "SELECT ROW_NUMBER() OVER (ORDER BY grid_order) AS line, id FROM sub"),
    "unscorable_counts": _with(BASE_LINES, """SELECT fold, baseline, COUNT(*) AS n, COUNT(*) FILTER (unique_id % 7 = 0) AS odd, COUNT(*) FILTER (horizon_day = 3 AND weight > 0) AS negative,
      ROUND(SUM(CASE WHEN horizon_day = 3 THEN -weight ELSE weight END), 6) AS w, ROUND(SUM(ABS(sales)), 6) AS y, ROUND(SUM(sales), 6) AS s FROM long WHERE baseline IN ('trailing_7_day_mean', 'last_observed_by_id') GROUP BY 1, 2"""),
    "column_gaps": " UNION ALL ".join(_gaps(table, wanted) for table, wanted in _WANTED.items()),
    "training_rows": _with("", f"""SELECT CAST(o.origin AS DATE) AS origin, COUNT(k.sales) AS rows, ROUND(SUM(k.sales), 6) AS sales FROM
      (SELECT CAST(DATE '{FOLDS["F1"]}' - CAST(14 * i AS INT) AS DATE) AS origin FROM range(1, 13) r(i)) o, grid g JOIN known k ON k.unique_id = g.unique_id AND k.date = CAST(o.origin + g.horizon_day AS DATE) GROUP BY 1"""),
}
assert len(BASE) == 36
