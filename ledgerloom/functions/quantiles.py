"""Exact quantiles of groups of any size, by histograms that are refined around the wanted ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from ledgerloom.functions.storage import discard, materialize

#: A pass parts a range into so many buckets of equal width at most.
BITS = 11


def _whole(df: DataFrame, value: str) -> tuple[Column, int]:
    """``value`` as a whole number of units, and the decimal places of a unit."""
    kind = df.schema[value].dataType
    scale = kind.scale if isinstance(kind, DecimalType) else 0 if isinstance(kind, IntegralType) else 6
    return (F.col(value).cast(f"decimal(38,{scale})") * F.lit(10**scale)).cast("bigint"), scale


def _located(counts: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Each wanted rank in the bucket that holds it: its place among the bucket's values, and the bucket as the next prefix."""
    w = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # the buckets of one range: at most 2 ** BITS rows
    before = counts.withColumn("before", F.coalesce(F.sum("count").over(w), F.lit(0)))
    inside = (F.col("rest") >= F.col("before")) & (F.col("rest") < F.col("before") + F.col("count"))
    return before.join(wanted, keys).where(inside).withColumns({"rest": F.col("rest") - F.col("before"), "prefix": F.col("bucket")})


def exact_quantiles(df: DataFrame, group: str, value: str, shares: list[float], least: int = 1) -> DataFrame:
    """(``group``, n, q): the number of values of each group and its quantiles at ``shares``, as ``percentile`` defines them.

    Values are decimals or whole numbers (others are taken to six decimal places); null values and null groups take no part, nor do groups of fewer than ``least``
    values. A quantile lies between two ranks. The range of all values is parted into buckets; counts per bucket, combined before the
    shuffle, tell which bucket holds each wanted rank; that bucket is parted again, until a bucket is one value. All groups are refined at
    once, in as many passes as the range has multiples of ``BITS`` bits. No state is larger than a histogram, and a group's values never meet in one task.
    """
    units, scale = _whole(df, value)
    rows = materialize(df.select(F.col(group).alias("group"), units.alias("v")).where("group is not null and v is not null"), "quantile-values")
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    if low is None:
        low = high = 0
    shift = 0
    while (high >> shift) - (low >> shift) >= 1 << BITS:
        shift += BITS
    sizes = rows.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    place = F.array(*(F.lit(float(s)) * (F.col("n") - 1) for s in shares))
    ends = sizes.select("group", "n", F.posexplode(place).alias("k", "place")).select("group", "n", "k", "place",
        F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor("place").alias("rest")), F.struct(F.lit(1).alias("side"), F.ceil("place").alias("rest")))).alias("e")).select("group", "n", "k", "place", "e.*")
    ends = ends.withColumn("prefix", F.lit(0).cast("bigint"))
    held, open_ = rows.withColumn("prefix", F.lit(0).cast("bigint")), ends
    keys, previous = ["group", "prefix"], None
    while True:
        counts = held.withColumn("bucket", F.shiftright("v", shift)).groupBy(*keys, "bucket").agg(F.count("*").alias("count"))
        found = materialize(_located(counts, open_, keys).select("group", "n", "k", "place", "side", "rest", "prefix"), "quantile-ranks")
        if previous is not None:
            discard(previous)
        previous, open_ = found, found
        if shift == 0:
            break
        within = found.select(*keys).distinct()
        held = rows.withColumn("prefix", F.shiftright("v", shift)).join(within, keys)
        shift -= BITS
    discard(rows)
    number = F.col("prefix").cast("double") / float(10**scale)
    both = found.groupBy("group", "n", "k", "place").agg(F.max(F.when(F.col("side") == 0, number)).alias("lower"), F.max(F.when(F.col("side") == 1, number)).alias("upper"))
    part = F.col("place") - F.floor("place")
    between = F.when(F.col("lower") == F.col("upper"), F.col("lower")).otherwise((F.ceil("place") - F.col("place")) * F.col("lower") + part * F.col("upper"))
    out = both.groupBy("group", "n").agg(F.array_sort(F.collect_list(F.struct("k", between.alias("q")))).alias("q"))
    return out.select(F.col("group").alias(group), "n", F.transform("q", lambda x: x["q"]).alias("q"))
