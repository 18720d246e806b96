"""Column profiles: exact smaller types, one aggregate for all columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORY_SHARE = 0.10
FLOAT_ERROR = 1e-6
_UNSIGNED = ((255, "uint8"), (65_535, "uint16"), (4_294_967_295, "uint32"))
_SIGNED = ((127, "int8"), (32_767, "int16"), (2_147_483_647, "int32"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per numeric column: counts, range, whether all values are whole, the largest relative error
    as a 32-bit float, the smallest exact integer type, and whether codes would pay."""
    measures = []
    for c in columns:
        x = F.col(c).cast("double")
        narrow = F.abs(x - x.cast("float").cast("double")) / F.greatest(F.abs(x), F.lit(1.0))
        measures.append(
            F.struct(
                F.lit(c).alias("column"), F.count("*").alias("rows"), F.count(c).alias("known"), F.countDistinct(c).alias("different"),
                F.min(x).alias("low"), F.max(x).alias("high"), F.coalesce(F.bool_and(x == F.rint(x)), F.lit(True)).alias("whole"),
                F.coalesce(F.max(narrow), F.lit(0.0)).alias("float_error"),
            ).alias(f"_{c}")
        )
    one = df.agg(*measures)
    long = one.select(F.explode(F.array(*[F.col(f"_{c}") for c in columns])).alias("x")).select("x.*")
    low, high = F.col("low"), F.col("high")
    kind = F.when(F.col("known") == 0, "uint8")
    for top, name in _UNSIGNED:
        kind = kind.when(F.col("whole") & (low >= 0) & (high <= top), name)
    kind = kind.when(F.col("whole") & (low >= 0), "uint64")
    for top, name in _SIGNED:
        kind = kind.when(F.col("whole") & (low >= -top - 1) & (high <= top), name)
    kind = kind.when(F.col("whole"), "int64")
    safe = F.col("float_error") <= FLOAT_ERROR
    return long.withColumns(
        {
            "kind": kind.when(safe, "float32").otherwise("float64"), "float_safe": safe,
            "encode": F.try_divide(F.col("different"), F.col("rows")) <= CATEGORY_SHARE,
        }
    )
