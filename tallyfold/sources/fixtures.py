"""The supplied star-schema tables projected into the retail domain.

One lineitem is a sale of a brand in a region: brand x region is an item, a ship date is a sales day.
The projection leaves holes: some sales are null, and one item has no history before the last fold,
so that every fallback is used.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import DISCOUNTS
from .tables import read_parquet

STEP = 14
#: Cutoffs of the validation folds, newest first, and the final origin.
FOLDS = {"F1": date(2001, 10, 7), "F2": date(2001, 9, 23), "F3": date(2001, 9, 9), "F4": date(2001, 8, 26)}
FINAL = date(2001, 10, 21)
NEW_ITEM = 110


def origins(cutoff: date, n: int = 12) -> list[date]:
    """Training origins of a cutoff, newest first, one forecast window apart."""
    return [cutoff - timedelta(days=STEP * i) for i in range(1, n + 1)]


#: Suppliers up to which their regions are sent to every task (some 40 bytes each).
BROADCAST_SUPPLIERS = 1_000_000


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item and day with a sale: the sums that history and inventory are made of.

    Lines are summed up by product, region's number and day, all of them numbers, so that sums are hashed and
    no line is sorted for them; names come to the sums.  Regions that share an item's number are summed up once more."""
    line = read_parquet(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", F.col("l_shipdate").cast("date").alias("date"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
    )
    part = read_parquet(spark, sf_dir, "part").select("p_partkey", F.substring("p_brand", 7, 10).cast("int").alias("product_unique_id"))
    supplier = read_parquet(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    few = supplier.count() <= BROADCAST_SUPPLIERS
    nation = read_parquet(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("int").alias("rk"))
    region = read_parquet(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("rk"), F.col("r_name").alias("warehouse"))
    place = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "rk")
    placed = line.join(F.broadcast(place) if few else place, F.col("l_suppkey") == F.col("s_suppkey"))
    joined = placed.join(part, F.col("l_partkey") == F.col("p_partkey"))
    slots = [f"_d{i}" for i in range(len(DISCOUNTS))]
    most = [F.max(F.when(F.col("l_linenumber") == i + 1, F.col("l_discount") * (-1 if i == 4 else 1))).alias(c) for i, c in enumerate(slots)]
    sums = joined.groupBy("product_unique_id", "rk", "date").agg(F.sum("l_quantity").alias("sold"), F.sum("cents").alias("cents"), *most)
    named = sums.join(region, "rk").withColumn("unique_id", (F.col("product_unique_id") * 10 + F.col("rk")).cast("int"))
    return named.groupBy("unique_id", "date").agg(
        F.min("product_unique_id").alias("product_unique_id"), F.min("warehouse").alias("warehouse"), F.sum("sold").alias("sold"), F.sum("cents").alias("cents"),
        *[F.max(c).alias(c) for c in slots],
    )


def history(spark: SparkSession, sf_dir: str, holes: bool = True) -> DataFrame:
    """One row per (``unique_id``, ``date``) with a sale."""
    discounts = [F.coalesce(F.col(f"_d{i}"), F.lit(0.0)).alias(c) for i, c in enumerate(DISCOUNTS)]
    full = daily(spark, sf_dir).select(
        "unique_id", "date", "warehouse", F.col("sold").alias("sales"), (F.col("cents") / (F.col("sold") * 100)).alias("sell_price_main"), *discounts
    )
    if not holes:
        return full
    lost = (F.col("unique_id") + F.dayofmonth("date")) % 97 == 0
    new = (F.col("unique_id") == NEW_ITEM) & (F.col("date") <= F.lit(FOLDS["F4"]))
    return full.withColumn("sales", F.when(~lost, F.col("sales"))).filter(~new)


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    product = F.min("product_unique_id")
    named = [F.concat(F.lit(f"L{i}_"), (product % m).cast("string")).alias(f"L{i}_category_name_en") for i, m in ((1, 3), (2, 5), (3, 7), (4, 4))]
    return daily(spark, sf_dir).groupBy("unique_id").agg(product.alias("product_unique_id"), F.min("warehouse").alias("warehouse"), *named)


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per warehouse and day, flags by fixed rules."""
    days = spark.sql("SELECT explode(sequence(DATE'1995-01-01', DATE'2001-12-31', INTERVAL 1 DAY)) AS date")
    flags = days.select(
        "date",
        (F.dayofmonth("date") == 1).cast("int").alias("holiday"),
        ((F.month("date") == 1) & (F.dayofmonth("date") == 1)).cast("int").alias("shops_closed"),
        F.month("date").isin(1, 2).cast("int").alias("winter_school_holidays"),
        F.month("date").isin(7, 8).cast("int").alias("school_holidays"),
    )
    names = read_parquet(spark, sf_dir, "region").select(F.col("r_name").alias("warehouse"))
    return names.crossJoin(F.broadcast(flags))  # a fixed number of days


def weights(inv: DataFrame) -> DataFrame:
    return inv.select("unique_id", ((1 + F.col("unique_id") % 7).cast("double") / 2).alias("weight"))


def request_mask(inv: DataFrame) -> DataFrame:
    """Requested (``unique_id``, ``horizon_day``), with deterministic holes."""
    days = inv.select("unique_id", F.explode(F.sequence(F.lit(1), F.lit(STEP))).alias("horizon_day"))
    return days.filter((F.col("unique_id") + F.col("horizon_day")) % 13 != 0)


def sales_test(inv: DataFrame) -> DataFrame:
    """Requests after the final origin: ``unique_id``, ``date``."""
    mask = request_mask(inv)
    return mask.select("unique_id", F.date_add(F.lit(FINAL), F.col("horizon_day")).alias("date"))
