"""Exact quantiles against Spark's own, whose state is a group's distinct values."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import quantiles
from ledgerloom.functions.quantiles import exact_quantiles
from ledgerloom.operators import behavior as b

SHARES = [0.0, 0.25, 1 / 3, 0.5, 0.75, 0.999, 1.0]


def both(df, least=1):
    got = {r.g: (r.n, r.q) for r in exact_quantiles(df, "g", "v", SHARES, least=least).collect()}
    want = df.where("g is not null and v is not null").groupBy("g").agg(F.count("*").alias("n"), F.percentile(F.col("v").cast("double"), F.array(*map(F.lit, SHARES))).alias("q"))
    return got, {r.g: (r.n, r.q) for r in want.collect() if r.n >= least}


@pytest.mark.parametrize("bits", [2, 5, 11])
def test_decimals_as_percentile(spark, monkeypatch, bits):
    monkeypatch.setattr(quantiles, "BITS", bits)
    rng = random.Random(bits)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot", None]), Decimal(rng.randrange(-50_000, 9_000_000)) / 100) for _ in range(3000)]
    rows += [("one", Decimal("12.34")), ("same", Decimal("5")), ("same", Decimal("5")), ("a", None), ("none", None), ("wide", Decimal("-9999999999.99")), ("wide", Decimal("9999999999.99"))]
    got, want = both(spark.createDataFrame(rows, "g string, v decimal(18,2)"))
    assert got.keys() == want.keys() and "none" not in got
    for g, (n, q) in want.items():
        assert got[g][0] == n and got[g][1] == pytest.approx(q, abs=1e-9)


def test_whole_numbers_one_group_and_least(spark):
    got, want = both(spark.range(20_000).select(F.lit(1).alias("g"), (F.col("id") * F.col("id") % 7919).alias("v")), least=5)
    assert got == want
    few = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "g string, v int")
    assert both(few, least=2)[0] == {"b": (2, both(few, least=2)[1]["b"][1])}
    assert exact_quantiles(few.limit(0), "g", "v", [0.5]).count() == 0


def test_a_category_with_all_rows(spark):
    tx = spark.range(5000).select(F.col("id").cast("string").alias("transaction_id"), F.lit("2026-01-02").cast("date").alias("date"),
        F.when(F.col("id") < 3, -100_000).otherwise(-(F.col("id") % 977)).cast("decimal(18,2)").alias("amount"), F.lit("shop").alias("merchant_raw"), F.lit("dining").alias("category"))
    found = b.anomalies(tx)
    assert sorted(r.transaction_id for r in found.collect()) == ["0", "1", "2"]
    assert "percentile" not in found._jdf.queryExecution().toString()
