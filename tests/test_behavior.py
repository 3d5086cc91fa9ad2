"""Detectors on small ledgers with known answers, and priority against hand-worked values."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import behavior as b
from ledgerloom.operators import dashboard as k


@pytest.fixture(scope="module")
def ledger(spark):
    rows, n = [], 0
    spend = {"dining": [300, 310, 325, 640, 320, 300], "groceries": [640, 650, 660, 655, 985, 640], "health": [40, 41, 42, 60, 80, 40]}
    for category, totals in spend.items():
        for m, total in enumerate(totals, 1):
            for part in range(4):
                n += 1
                rows.append((f"t{n:03}", dt.date(2026, m, 3 + part), Decimal(-total) / 4, "shop", category))
    rows += [(f"i{m}", dt.date(2026, m, 1), Decimal(3000 if m != 5 else 1500), "ACME PAYROLL", "income") for m in range(1, 7)]
    rows.append(("odd", dt.date(2026, 2, 9), Decimal("-400.00"), "Jeweller", "gifts"))
    rows += [(f"g{d}", dt.date(2026, 2, d), Decimal("-20.00"), "Gift shop", "gifts") for d in range(10, 20)]
    rows += [("null", dt.date(2026, 2, 9), Decimal("-1.00"), None, None)]
    return spark.createDataFrame(rows, "transaction_id string, date date, amount decimal(18,2), merchant_raw string, category string")


def test_grid_is_dense_and_nulls_stay_out(ledger):
    grid = b.monthly_totals(ledger)
    assert grid.count() == 6 * 5
    assert grid.where("category = 'gifts' and month = '2026-04'").first().total == 0


def test_spikes(ledger):
    got = {(r.category, r.month): r for r in b.spikes(b.monthly_totals(ledger)).collect()}
    assert ("dining", "2026-04") in got and ("groceries", "2026-05") in got
    r = got["dining", "2026-04"]
    assert (r.current_amount, r.baseline_amount, r.severity) == (640.0, 311.67, "high") and r.change_pct == 105.3
    assert not any(c == "health" for c, _ in got)


def test_drift_and_change(ledger):
    monthly = b.monthly_totals(ledger)
    assert {(r.category, r.month) for r in b.drift(monthly, threshold_pct=25).collect()} == {("health", "2026-05"), ("dining", "2026-04")}
    change = {(r.category, r.month): r.change_pct for r in b.mom_changes(monthly).collect()}
    assert change["dining", "2026-01"] == 0 and change["gifts", "2026-02"] == float("inf") and change["gifts", "2026-03"] == -100


def test_anomalies_and_savings(ledger):
    odd = b.anomalies(ledger).where("category = 'gifts'").collect()
    assert [(r.transaction_id, r.severity, r.upper_bound) for r in odd] == [("odd", "high", 20.0)]
    rates = b.savings_rate(b.monthly_totals(ledger))
    assert {r.month for r in b.savings_drops(rates).collect()} >= {"2026-05"}
    assert b.savings_rate(b.monthly_totals(ledger.where("category <> 'income'"))).count() == 0


def test_goals_and_priority(spark, ledger):
    goals = spark.createDataFrame([("dining_budget", 400.0, None), ("grocery_budget", 600.0, None), ("savings_rate", None, 0.2)], "goal_name string, limit double, target double")
    events = b.detect_all(ledger, goals).cache()
    budget = events.where("goal_name = 'dining_budget'").collect()
    assert len(budget) == 6 and [r.status for r in sorted(budget, key=lambda r: r.month)].count("exceeded") == 1
    assert [r.goal_name for r in b.unmatched_goals(b.monthly_totals(ledger), goals).collect()] == ["grocery_budget"]
    hand = spark.createDataFrame([("spending_spike", 105.0, None, None, "high", 0.95, "2026-04")], "type string, change_pct double, drop_pct double, amount double, severity string, confidence double, month string")
    assert hand.select(b.priority_score()).first()[0] == 0.972
    top = b.prioritize(events, 3).collect()
    assert len(top) == 3 and [r.priority_score for r in top] == sorted((r.priority_score for r in top), reverse=True)
    assert b.events_by(events, category="dining", month="2026-04").count() >= 2


def test_dashboard(ledger):
    r = k.kpis(ledger).first()
    assert r.income == 16500 and r.transactions == ledger.count()
    assert k.kpis(ledger.limit(0)).first().savings_pct == 0
    assert [x.category for x in k.top_categories(ledger, 2).collect()] == ["groceries", "dining"]
    assert k.filter_transactions(ledger, merchant="JEWEL").count() == 1
    assert ledger.where("transaction_id = 'odd'").select(k.amount_text(F.col("amount"))).first()[0] == "$-400.00"
    assert all(-100 <= x.savings_pct <= 100 for x in k.savings_line(ledger).collect())
