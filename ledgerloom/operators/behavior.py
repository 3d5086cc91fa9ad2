"""Behavioural change: monthly grid, spikes, drift, anomalies, savings, goals and ranked events.

Inputs are transactions (transaction_id, date, amount, merchant_raw, category); amounts are decimals, so sums do not
depend on the order of rows. After the monthly sums, rows are few (months times categories); the windows over all
months have one row a month.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.quantiles import exact_quantiles
from ledgerloom.functions.text import contains_any

INCOME = "income"
#: Event columns in one order for all detectors.
EVENT_COLUMNS = (
    "event_type", "type", "category", "month", "severity", "confidence", "current_amount", "baseline_amount",
    "change_pct", "z_score", "rolling_avg_current", "rolling_avg_previous",
    "transaction_id", "amount", "merchant", "upper_bound", "exceeds_by_pct", "savings_rate_previous",
    "savings_rate_current", "drop_pct", "goal_name", "status", "budget_limit", "amount_spent",
    "remaining", "pct_used", "target_rate_pct", "actual_rate_pct", "gap_pct", "date", "income", "expenses",
)
#: The order in which detectors are listed breaks ties of priority.
EVENT_ORDER = ("spikes", "drifts", "anomalies", "savings_drops", "goals")


def money(x: Column) -> Column:
    return F.bround(x, 2)


def with_month(tx: DataFrame) -> DataFrame:
    return tx.withColumn("month", F.date_format("date", "yyyy-MM"))


def monthly_totals(tx: DataFrame) -> DataFrame:
    """Dense grid of month by category with the sum of amounts; a cell without rows is 0. Null keys are left out.

    Every cell is a row of the result, so it has months times categories rows: small for a list of categories, large where ``category`` is free text.
    """
    sums = with_month(tx).where("category is not null and date is not null").groupBy("month",
        "category").agg(F.sum("amount").cast("double").alias("total"))
    grid = sums.select("month").distinct().crossJoin(sums.select("category").distinct())
    return grid.join(sums, ["month", "category"], "left").withColumn("total", F.coalesce("total", F.lit(0.0)))


def _by_category():
    return Window.partitionBy("category").orderBy("month")


def mom_changes(monthly: DataFrame) -> DataFrame:
    """Percentage change of the absolute total to the month before: 0 for the first month and for 0 after 0, infinite after 0."""
    now, before = F.abs("total"), F.lag(F.abs("total")).over(_by_category())
    change = F.when(before.isNull() | ((before == 0) & (now == 0)), F.lit(0.0)).when(before == 0,
        F.lit(float("inf"))).otherwise((now / F.nullif(before, F.lit(0.0)) - 1) * 100)
    return monthly.select("month", "category", change.alias("change_pct"))


def spikes(monthly: DataFrame, z: float = 1.8, lookback: int = 3, least_pct: float = 40,
    least_change: float = 200) -> DataFrame:
    """Months that stand out from the mean and sample deviation of the months before (two at least)."""
    w = _by_category().rowsBetween(-lookback, -1)
    s = F.abs("total")
    rows = monthly.where(F.col("category") != INCOME).withColumns(
        {"s": s, "n": F.count(s).over(w), "mean": F.avg(s).over(w), "sd": F.stddev_samp(s).over(w)})
    rows = rows.where("n >= 2 and sd > 0 and mean <> 0").withColumns(
        {"zs": (F.col("s") - F.col("mean")) / F.col("sd"), "pct": (F.col("s") - F.col("mean")) / F.col("mean") * 100})
    rows = rows.where((F.abs("zs") > z) & (F.abs("pct") >= least_pct)
        & (F.abs(F.col("s") - F.col("mean")) >= least_change))
    return rows.select(
        F.lit("spending_spike").alias("type"), "category", "month", money(F.col("s")).alias("current_amount"),
        money(F.col("mean")).alias("baseline_amount"), F.bround("pct", 1).alias("change_pct"),
        F.bround("zs", 2).alias("z_score"), F.when(F.abs("zs") > 3, "high").otherwise("medium").alias("severity"),
        F.least(F.lit(0.95), 0.7 + F.abs("zs") * 0.05).alias("confidence"))


def drift(monthly: DataFrame, threshold_pct: float = 30.0, window: int = 3) -> DataFrame:
    """Rolling means that rise by more than the threshold, after a month in which they rose too."""
    w = _by_category()
    frame = w.rowsBetween(-window + 1, 0)
    s = F.abs("total")
    rows = monthly.where(F.col("category") != INCOME).withColumn("r",
        F.when(F.count(s).over(frame) >= 2, F.avg(s).over(frame)))
    rows = rows.withColumn("before", F.lag("r").over(w))
    change = F.when((F.col("before") == 0) & (F.col("r") > 0), F.lit(float("inf"))).when(F.col("before") != 0,
        (F.col("r") / F.col("before") - 1) * 100)
    rows = rows.withColumn("c", change).withColumn("c0",
        F.lag("c").over(w)).where((F.col("c") > threshold_pct) & (F.col("c0") > 0))
    return rows.select(
        F.lit("category_drift").alias("type"), "category", "month", money(F.col("r")).alias("rolling_avg_current"),
        money(F.col("before")).alias("rolling_avg_previous"),
        F.bround("c", 1).alias("change_pct"), F.when(F.col("c") > 50, "high").otherwise("medium").alias("severity"),
        F.least(F.lit(0.9), 0.6 + F.col("c") / 100).alias("confidence"))


def anomalies(tx: DataFrame, multiplier: float = 1.5, digits: int = 2) -> DataFrame:
    """Transactions beyond the upper quartile by more than ``multiplier`` interquartile ranges of their category (four rows at least).

    Quartiles are exact, found by refined histograms, so a category of any size is never one task's. The bounds have a row per
    category; the planner broadcasts them when they are small.
    """
    rows = tx.where((F.col("category") != INCOME) & F.col("category").isNotNull()).withColumn("size", F.abs("amount"))
    q = exact_quantiles(rows, "category", "size", [0.25, 0.75], least=4)
    rows = rows.withColumn("a", F.col("size").cast("double"))
    q = q.select("category", F.col("q")[1].alias("q3"),
        (F.col("q")[1] - F.col("q")[0]).alias("iqr")).withColumn("bound", F.col("q3") + multiplier * F.col("iqr"))
    rows = rows.join(q, "category").where("a > bound")
    extreme = F.col("a") > F.col("q3") + 3 * F.col("iqr")
    return rows.select(
        F.lit("anomaly").alias("type"), "category", F.col("transaction_id"),
        F.date_format("date", "yyyy-MM-dd").alias("date"), F.date_format("date", "yyyy-MM").alias("month"),
        money(F.col("a")).alias("amount"), F.col("merchant_raw").alias("merchant"),
        F.bround("bound", digits).alias("upper_bound"),
        F.when(F.col("bound") > 0, F.bround((F.col("a") - F.col("bound")) / F.nullif("bound", F.lit(0.0)) * 100, 1))
        .otherwise(0.0).alias("exceeds_by_pct"),
        F.when(extreme, "high").otherwise("medium").alias("severity"),
        F.when(extreme, 0.85).otherwise(0.75).alias("confidence"))


def savings_rate(monthly: DataFrame) -> DataFrame:
    """Income, expenses and the rate saved, per month; no rows without an income category. The rate is 0 without income."""
    rows = monthly.groupBy("month").agg(
        F.max(F.when(F.col("category") == INCOME, F.col("total"))).alias("income"),
        F.bround(F.abs(F.sum(F.when(F.col("category") != INCOME, F.col("total")).otherwise(0.0))), 2).alias("expenses"))
    rows = rows.where("income is not null").withColumn("savings", F.col("income") - F.col("expenses"))
    rate = F.coalesce(F.try_divide("savings", "income"), F.lit(0.0))
    return rows.withColumn("savings_rate", rate).withColumn("savings_rate_pct",
        F.bround(F.col("savings_rate") * 100, 1))


def savings_drops(rates: DataFrame, threshold_pct: float = 20.0) -> DataFrame:
    """Months whose rate falls by more than the threshold, relative to a positive rate the month before."""
    rows = rates.withColumn("before", F.lag("savings_rate").over(Window.orderBy("month"))).where("before > 0")
    rows = rows.withColumn("c",
        (F.col("savings_rate") - F.col("before")) / F.col("before") * 100).where(F.col("c") < -threshold_pct)
    return rows.select(
        F.lit("savings_drop").alias("type"), F.lit("savings").alias("category"), "month",
        F.bround(F.col("before") * 100, 1).alias("savings_rate_previous"),
        F.bround(F.col("savings_rate") * 100, 1).alias("savings_rate_current"),
        F.bround(F.abs("c"), 1).alias("drop_pct"), money(F.col("income")).alias("income"),
        money(F.col("expenses")).alias("expenses"),
        F.when(F.col("c") < -40, "high").otherwise("medium").alias("severity"),
        F.least(F.lit(0.95), 0.7 + F.abs("c") / 100).alias("confidence"))


def budget_goals(monthly: DataFrame, goals: DataFrame) -> DataFrame:
    """Spending against monthly limits. ``goals``: (goal_name, limit). A goal whose category does not occur gives no rows."""
    g = goals.where(contains_any(F.col("goal_name"), ("category", "_budget")))
    g = g.select("goal_name",
        F.replace(F.replace("goal_name", F.lit("_budget"), F.lit("")), F.lit("_"), F.lit(" ")).alias("category"),
        F.col("limit").cast("double").alias("budget_limit"))
    rows = monthly.join(g, "category").withColumn("spent", F.abs("total"))
    used = F.when(F.col("budget_limit") > 0, F.col("spent") / F.nullif("budget_limit", F.lit(0.0)) * 100).otherwise(0.0)
    return rows.withColumn("u", used).select(
        F.lit("goal_status").alias("type"), "goal_name", "category", "month", "budget_limit",
        money(F.col("spent")).alias("amount_spent"), money(F.col("budget_limit") - F.col("spent")).alias("remaining"),
        F.bround("u", 1).alias("pct_used"),
        F.when(F.col("spent") <= F.col("budget_limit"), "on_track").otherwise("exceeded").alias("status"),
        F.when(F.col("u") > 100, "warning").when(F.col("u") > 80, "caution").otherwise("good").alias("severity"),
        F.lit(0.9).alias("confidence"))


def unmatched_goals(monthly: DataFrame, goals: DataFrame) -> DataFrame:
    """Budget goals whose category no transaction has."""
    g = goals.where(contains_any(F.col("goal_name"), ("category", "_budget"))).withColumn("category",
        F.replace(F.replace("goal_name", F.lit("_budget"), F.lit("")), F.lit("_"), F.lit(" ")))
    return g.join(monthly.select("category").distinct(), "category", "left_anti").select("goal_name", "category")


def savings_goals(rates: DataFrame, goals: DataFrame) -> DataFrame:
    """The rate saved against each savings goal (target 0.20 unless given). ``goals``: (goal_name, target); few rows."""
    g = goals.where(F.contains("goal_name", F.lit("savings_rate"))
        & ~contains_any(F.col("goal_name"), ("category", "_budget"))).select("goal_name",
        F.coalesce(F.col("target").cast("double"), F.lit(0.2)).alias("t"))
    rows = rates.crossJoin(g)
    r = F.col("savings_rate")
    return rows.select(
        F.lit("goal_status").alias("type"), "goal_name", "month",
        F.bround(F.col("t") * 100, 1).alias("target_rate_pct"), F.bround(r * 100, 1).alias("actual_rate_pct"),
        F.bround((F.col("t") - r) * 100, 1).alias("gap_pct"),
        F.when(r >= F.col("t"), "on_track").otherwise("below_target").alias("status"),
        F.when(r < F.col("t") * 0.5, "warning").when(r < F.col("t"), "caution").otherwise("good").alias("severity"),
        F.lit(0.9).alias("confidence"))


def detect_all(tx: DataFrame, goals: DataFrame) -> DataFrame:
    """All detectors' events as one table, tagged by ``event_type``; columns a detector lacks are null."""
    monthly = monthly_totals(tx)
    rates = savings_rate(monthly)
    parts = {
        "spikes": spikes(monthly), "drifts": drift(monthly), "anomalies": anomalies(tx),
        "savings_drops": savings_drops(rates),
        "goals": budget_goals(monthly, goals).unionByName(savings_goals(rates, goals), allowMissingColumns=True),
    }
    tagged = [parts[k].withColumn("event_type", F.lit(k)) for k in EVENT_ORDER]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return every.select(*EVENT_COLUMNS)


def priority_score(months: float = 6.0) -> Column:
    """40 % size of the change, 30 % confidence, 20 % severity, 10 % month of the year over ``months``."""
    size = F.coalesce(F.least(F.abs("change_pct") / 100, F.lit(2.0)), F.least(F.col("drop_pct") / 50, F.lit(2.0)),
        F.least(F.col("amount") / 500, F.lit(2.0)), F.lit(0.5))
    severity = F.lit(0.5)
    for name, value in (("high", 1.0), ("medium", 0.6), ("low", 0.3), ("warning", 0.8), ("caution", 0.5),
        ("good", 0.2)):
        severity = F.when(F.coalesce("severity", F.lit("medium")) == name, value).otherwise(severity)
    recent = F.coalesce(F.try_to_number(F.substring(F.coalesce("month", F.lit("2026-01")), 6, 2), F.lit("99"))
        .cast("double") / months, F.lit(0.5))
    return F.bround(size * 0.4 + F.coalesce("confidence", F.lit(0.7)) * 0.3 + severity * 0.2 + recent * 0.1, 3)


def _tie_order() -> list[Column]:
    seq = F.lit(len(EVENT_ORDER))
    for k, name in enumerate(EVENT_ORDER):
        seq = F.when(F.col("event_type") == name, k).otherwise(seq)
    return [seq, F.col("category"), F.col("month"), F.col("goal_name").asc_nulls_first(),
        F.col("transaction_id").asc_nulls_first()]


def prioritize(events: DataFrame, top_n: int = 10) -> DataFrame:
    """The ``top_n`` events by priority; ties keep the detectors' order, then category, month, goal and transaction."""
    scored = events.withColumn("priority_score", priority_score())
    return scored.orderBy(F.desc("priority_score"), *_tie_order()).limit(top_n)


def events_by(events: DataFrame, category: str | None = None, month: str | None = None) -> DataFrame:
    out = events
    if category is not None:
        out = out.where(F.col("category") == category)
    if month is not None:
        out = out.where(F.col("month") == month)
    return out


def summary(tx: DataFrame, events: DataFrame) -> DataFrame:
    """One row: transactions, first and last date, distinct categories, and events of each detector."""
    basics = tx.agg(F.count("*").alias("total_transactions"), F.min("date").cast("string").alias("start"),
        F.max("date").cast("string").alias("end"), F.count_distinct("category").alias("categories"))
    counts = events.agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in EVENT_ORDER))
    return basics.crossJoin(counts)  # one row each


def export_sections(tx: DataFrame, events: DataFrame, top_n: int = 10) -> dict[str, DataFrame]:
    """The parts of a complete report, as tables that stay distributed: ``summary`` (one row, with the number of all events),
    ``all_events`` of each detector with their priority, ``top_priorities`` with their rank, ``categories_affected``."""
    scored = events.withColumn("priority_score", priority_score())
    top = prioritize(events, top_n)
    rank = F.row_number().over(Window.orderBy(F.desc("priority_score"), *_tie_order()))  # of ``top_n`` rows
    total = sum((F.col(k) for k in EVENT_ORDER), F.lit(0)).cast("bigint")
    return {
        "summary": summary(tx, events).withColumn("total_events", total), "all_events": scored,
        "top_priorities": top.withColumn("rank", rank),
        "categories_affected": events.select("category").where("category is not null and category <> ''").distinct(),
    }


def export_results(tx: DataFrame, events: DataFrame, path: str, top_n: int = 10) -> dict[str, DataFrame]:
    """Write the report's parts as JSON below ``path``, a folder each, the events by detector; returns the parts."""
    parts = export_sections(tx, events, top_n)
    for name, df in parts.items():
        out = df.write.mode("overwrite")
        (out.partitionBy("event_type") if name == "all_events" else out).json(f"{path.rstrip('/')}/{name}")
    return parts
