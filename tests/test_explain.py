"""Requests and texts of events and matches, held against sentences written out by hand."""

import json
import random

from pyspark.sql import functions as F

from ledgerloom.functions.text import round_binary
from ledgerloom.operators import behavior as b
from ledgerloom.operators import explain as x


def event(spark, **fields):
    kinds = {"category": "string", "type": "string", "event_type": "string", "month": "string", "severity": "string", "transaction_id": "string", "merchant": "string", "goal_name": "string",
        "status": "string", "date": "string"}
    return spark.createDataFrame([tuple(fields.get(k) for k in b.EVENT_COLUMNS)], ", ".join(f"{k} {kinds.get(k, 'double')}" for k in b.EVENT_COLUMNS))


def request(spark, **fields):
    return x.explain_events(event(spark, **fields)).first().request


def test_requests(spark):
    assert request(spark, type="spending_spike", category="dining", month="2026-04", current_amount=640.0, baseline_amount=311.67, change_pct=105.3, z_score=9.14) == (
        "The user's dining spending in 2026-04 was $640.00, 105% above their usual $311.67 (Z-score: 9.1). Explain and suggest one action.")
    assert request(spark, type="category_drift", category="health", month="2026-05", rolling_avg_current=61.0, rolling_avg_previous=41.0, change_pct=48.8) == (
        "The user's health 3-month rolling average rose 49% from $41.00 to $61.00 as of 2026-05. This is a gradual upward trend. Explain and suggest one action.")
    assert request(spark, type="anomaly", category="gifts", amount=4000.5, merchant="Jeweller", date="2026-02-09", exceeds_by_pct=1900.0, upper_bound=20.0) == (
        "A gifts transaction of $4000.50 at Jeweller on 2026-02-09 is 1900% above the normal upper limit of $20.00 (IQR outlier detection). Explain and suggest one action.")
    assert request(spark, type="savings_drop", month="2026-05", savings_rate_previous=31.25, savings_rate_current=8.0, drop_pct=23.2, income=1500.0, expenses=1380.0) == (
        "The user's savings rate dropped from 31.2% to 8.0% in 2026-05 (a 23% drop). Income: $1,500.00, Expenses: $1,380.00. Explain what happened and suggest one concrete action.")
    assert request(spark, type="goal_status", goal_name="savings_rate", status="missed", month="2026-05", target_rate_pct=20.0, actual_rate_pct=8.0, gap_pct=12.0) == (
        "The user's savings rate is 8.0% in 2026-05, short of their 20% goal by 12.0 points. Give one specific suggestion.")
    assert request(spark, type="goal_status", goal_name="dining_budget", status="exceeded", month="2026-04", budget_limit=400.0, amount_spent=640.0, remaining=-240.0) == (
        "The user spent $640.00 on dining in 2026-04, exceeding their $400.00 budget by $240.00. Suggest one way to prevent this next month.")
    assert request(spark, type="goal_status", goal_name="dining_budget", status="on_track", pct_used=85.0) is None


def test_other_events(spark):
    got = x.explain_events(event(spark, type="new_kind", category="a \"b\"", amount=2.5, month="2026-01")).first()
    assert got.headline == "New Kind" and got.request == 'Explain this financial event in 2 sentences: {"type": "new_kind", "category": "a \\"b\\"", "month": "2026-01", "amount": 2.5}'
    assert json.loads(got.request.partition(": ")[2]) == {"type": "new_kind", "category": 'a "b"', "month": "2026-01", "amount": 2.5}
    assert len(request(spark, type="k", merchant="m" * 500)) == len(x.OTHER_REQUEST) + 300


def test_match(spark):
    fields = "t_id string, d_id string, match_type string, confidence double, string_similarity double, amount_match double, date_proximity double, document_trust double"
    df = spark.createDataFrame([("txn_003", "doc_003", "FUZZY", 0.898, 1.0, 0.7, 1.0, 0.88), ("t", "d", None, None, None, None, None, None)], fields)
    got = [r[0] for r in df.select(x.explain_match(df)).collect()]
    assert got[0] == ("Bank transaction txn_003 matched document doc_003 using FUZZY matching (90% confidence). Scores: merchant 100%, amount 70%, date 100%, document trust 88%. "
        "Explain in one sentence for a non-technical user.")
    assert got[1].startswith("Bank transaction t matched document d using UNKNOWN matching (0% confidence).")


def test_numbers_are_rounded_as_printed(spark):
    rng = random.Random(1)
    values = [-3.55, 2.5, 3.5, 0.125, 1e12 + 0.5, 2.675, -0.05, 0.0, 1e15] + [rng.randrange(10**7) / rng.choice([1000, 200, 40]) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2):
        got = [r[0] for r in df.select(F.format_string(f"%.{digits}f", round_binary(F.col("v"), digits))).collect()]
        assert [g.removeprefix("-") for g in got] == [f"{v:.{digits}f}".removeprefix("-") for v in values]  # the sign of a zero aside


def test_a_model_body_stands_in(spark):
    df = event(spark, type="anomaly", category="x").withColumn("said", F.lit("Because."))
    assert x.explain_events(df, body=F.col("said")).first().body == "Because."
