"""Dashboard queries: key figures, trends, top categories, filters and colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Card colours of severities, and score colours by lower bound.
CARD = {"high": "red", "warning": "red", "medium": "amber", "caution": "amber", "good": "green"}
SCORE = ((0.8, "#22c55e"), (0.5, "#f59e0b"))


def kpis(tx: DataFrame) -> DataFrame:
    """Count, income and expenses by sign, net, and the rate saved in percent (0 without income)."""
    a = F.col("amount")
    rows = tx.agg(F.count("*").alias("transactions"),
        F.coalesce(F.sum(F.when(a > 0, a)), F.lit(0)).cast("double").alias("income"),
        F.coalesce(F.abs(F.sum(F.when(a < 0, a))), F.lit(0)).cast("double").alias("expenses"))
    rows = rows.withColumn("net", F.col("income") - F.col("expenses"))
    return rows.withColumn("savings_pct",
        F.when(F.col("income") > 0, F.bround(F.col("net") / F.nullif("income", F.lit(0.0)) * 100, 1)).otherwise(0.0))


def spend_trend(tx: DataFrame) -> DataFrame:
    """Spending of each month and category that have expenses, in long form; a missing cell is 0."""
    sums = tx.where("amount < 0").groupBy(F.date_format("date", "yyyy-MM").alias("month"),
        "category").agg(F.abs(F.sum("amount")).cast("double").alias("spent"))
    grid = sums.select("month").distinct().crossJoin(sums.select("category").distinct())  # months times categories
    return grid.join(sums, ["month", "category"], "left").withColumn("spent", F.coalesce("spent", F.lit(0.0)))


def spend_trend_wide(tx: DataFrame, categories: list[str]) -> DataFrame:
    """The same as one column per category, for presentation."""
    return tx.where("amount < 0").groupBy(F.date_format("date", "yyyy-MM").alias("month")).pivot("category",
        categories).agg(F.abs(F.sum("amount")).cast("double")).na.fill(0.0)


def top_categories(tx: DataFrame, n: int = 7) -> DataFrame:
    """The ``n`` categories with the largest spending and their share of it all, at most 100 %."""
    sums = tx.where("amount < 0").groupBy("category").agg(F.abs(F.sum("amount")).cast("double").alias("spent"))
    total = F.sum("spent").over(Window.partitionBy())  # over a row per category
    shared = sums.withColumn("share_pct",
        F.least(F.lit(100.0), F.bround(F.coalesce(F.try_divide(F.col("spent"), total), F.lit(0.0)) * 100, 1)))
    return shared.orderBy(F.desc("spent"), "category").limit(n)


def alert_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def filter_transactions(tx: DataFrame, category: str | None = None, month: str | None = None,
    merchant: str | None = None) -> DataFrame:
    """Filters that reach the scan; ``merchant`` is a regular expression, case not counting."""
    out = tx
    if category:
        out = out.where(F.col("category") == category)
    if month:
        out = out.where(F.date_format("date", "yyyy-MM") == month)
    if merchant:
        out = out.where(F.rlike("merchant_raw", F.lit(f"(?i){merchant}")))
    return out


def filtered_summary(tx: DataFrame) -> DataFrame:
    k = kpis(tx)
    show = lambda c, sign: F.concat(F.lit(sign + "$"), F.format_number(c, 2))
    return k.select("transactions", F.col("expenses").alias("spent"), "income",
        show("expenses", "-").alias("spent_text"), show("income", "+").alias("income_text"))


def amount_text(a: Column) -> Column:
    """Signed, with separators and cents, as in ``$+1,234.50``."""
    return F.concat(F.lit("$"), F.when(a < 0, "-").otherwise("+"), F.format_number(F.abs(a), 2))


def recon_kpis(matches: DataFrame, n_transactions: Column) -> DataFrame:
    """Matches of each tier and the share of transactions matched."""
    tiers = [F.count_if(F.col("match_type") == t).alias(t.lower()) for t in ("EXACT", "FUZZY", "SEMANTIC")]
    return matches.agg(*tiers, F.count("*").alias("matched")).withColumn("match_rate",
        F.coalesce(F.try_divide(F.col("matched").cast("double"), n_transactions), F.lit(0.0)))


def savings_line(tx: DataFrame) -> DataFrame:
    """Rate saved of each month in percent, by sign; 0 where a side is missing, within +-100."""
    a = F.col("amount")
    rows = tx.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.coalesce(F.sum(F.when(a > 0, a)), F.lit(0)).cast("double").alias("income"),
        F.coalesce(F.abs(F.sum(F.when(a < 0, a))), F.lit(0)).cast("double").alias("expenses"))
    rate = F.coalesce(F.try_divide(F.col("income") - F.col("expenses"), "income") * 100, F.lit(0.0))
    return rows.select("month",
        F.bround(F.greatest(F.lit(-100.0), F.least(F.lit(100.0), rate)), 4).alias("savings_pct"))


def goals_partition(goals: DataFrame, n_others: int = 4) -> DataFrame:
    """Goals missed, all of them, and the first others in order of month and name."""
    missed = F.col("status").isin("exceeded", "below_target")
    rank = F.row_number().over(Window.partitionBy("missed")
        .orderBy("month", "goal_name"))  # a goal and month a row: few
    return goals.withColumn("missed", missed).withColumn("rank",
        rank).where(f"missed or rank <= {n_others}").select("goal_name", "month", "status", "missed")


def severity_colour(severity: Column) -> Column:
    out = F.lit("blue")
    for name, colour in CARD.items():
        out = F.when(severity == name, colour).otherwise(out)
    return out


def score_colour(score: Column) -> Column:
    """Green above 0.8, amber above 0.5, red below."""
    out = F.lit("#ef4444")
    for bound, colour in reversed(SCORE):
        out = F.when(score > bound, colour).otherwise(out)
    return out
