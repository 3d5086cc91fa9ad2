"""Accuracy and distribution reports of categorised transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def baseline_report(df: DataFrame) -> DataFrame:
    """One row: rows, mean confidence, accuracy against the hint, misses, rows of each level and type."""
    right = F.coalesce(F.col("category") == F.col("category_hint"), F.lit(False))
    levels = [F.count_if(F.col("confidence_level") == x).alias(x) for x in ("low", "medium", "high")]
    types = [F.count_if(F.col("transaction_type") == x)
        .alias(x.replace("-", "_")) for x in ("recurring", "repeat", "one-time")]
    return df.agg(
        F.count("*").alias("total"), F.bround(F.avg("confidence"), 4).alias("mean_confidence"),
        F.bround(F.avg(right.cast("int")), 3).alias("accuracy"),
        F.count_if(~right).alias("misclassified"), *levels, *types)


def low_confidence_categories(df: DataFrame, n: int = 5) -> DataFrame:
    """The categories most frequent among rows of low confidence; null counts as one."""
    return df.where("confidence_level = 'low'").groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"),
        F.col("category").asc_nulls_first()).limit(n)


def error_slices(df: DataFrame) -> dict[str, DataFrame]:
    """Rows of high and of low confidence, and transfers."""
    return {"high": df.where("confidence_level = 'high'"), "low": df.where("confidence_level = 'low'"),
        "transfer": df.where("category = 'transfer'")}


def in_slices(df: DataFrame) -> DataFrame:
    """The rows of all of ``error_slices`` with the name of the ``slice``, once for each that they are in: one pass over ``df``, not one a slice."""
    level, category = F.col("confidence_level"), F.col("category")
    slices = F.array(F.when(level == "high", "high"), F.when(level == "low", "low"), F.when(category == "transfer", "transfer"))
    return df.withColumn("slice", F.explode(F.array_compact(slices)))
