"""Queries of behaviour and dashboard, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import behavior as b
from ledgerloom.operators import dashboard as k
from ledgerloom.sources.tables import TRANSACTIONS, transactions

GOALS_SQL = """
select * from (values ('automobile_budget', cast(600000 as double), cast(null as double)), ('furniture_budget', 900000, null), ('grocery_budget', 600, null), ('savings_rate', null, 0.2), ('savings_rate_stretch', null, null))
as g(goal_name, "limit", target)
"""


def goals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [("automobile_budget", 600000.0, None), ("furniture_budget", 900000.0, None), ("grocery_budget", 600.0, None), ("savings_rate", None, 0.2), ("savings_rate_stretch", None, None)],
        "goal_name string, limit double, target double")


def _monthly(spark, d):
    return b.monthly_totals(transactions(spark, d))


def _events(spark, d):
    return b.detect_all(transactions(spark, d), goals(spark))


def _export(spark, d) -> DataFrame:
    """The report's parts under one another: events of each detector, ranked ones, categories and the total."""
    parts = b.export_sections(transactions(spark, d), _events(spark, d))
    c = F.col
    row = lambda df, section, *columns: df.select(F.lit(section).alias("section"), *columns)
    every = row(parts["all_events"], "all_events", "event_type", "category", "month", "goal_name", "transaction_id", "priority_score")
    top = row(parts["top_priorities"], "top_priorities", c("rank").cast("bigint").alias("n"), "event_type", "category", "month", "goal_name", "transaction_id", "priority_score")
    names = row(parts["categories_affected"], "categories_affected", "category")
    total = row(parts["summary"], "total_events", c("total_events").alias("n"))
    join = lambda x, y: x.unionByName(y, allowMissingColumns=True)
    return join(join(join(every, top), names), total)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "B0_month": lambda s, d: b.with_month(transactions(s, d)).groupBy("month").agg(F.count("*").alias("n")),
    "B1_monthly_totals": _monthly,
    "B2_mom_change": lambda s, d: b.mom_changes(_monthly(s, d)).withColumn("change_pct", F.bround("change_pct", 4)),
    "B3_spikes": lambda s, d: b.spikes(_monthly(s, d), z=1.0, least_pct=10).withColumn("confidence", F.bround("confidence", 6)),
    "B4_drift": lambda s, d: b.drift(_monthly(s, d), threshold_pct=5.0).withColumn("confidence", F.bround("confidence", 6)),
    "B5_anomalies": lambda s, d: b.anomalies(transactions(s, d), multiplier=0.5, digits=6),
    "B6_savings_rate": lambda s, d: b.savings_rate(_monthly(s, d)).withColumn("savings_rate", F.bround("savings_rate", 6)).withColumn("savings", F.bround("savings", 2)),
    "B7_savings_drops": lambda s, d: b.savings_drops(b.savings_rate(_monthly(s, d))).withColumn("confidence", F.bround("confidence", 6)),
    "B8_budget_goals": lambda s, d: b.budget_goals(_monthly(s, d), goals(s)),
    "B8_unmatched_goals": lambda s, d: b.unmatched_goals(_monthly(s, d), goals(s)),
    "B9_savings_goals": lambda s, d: b.savings_goals(b.savings_rate(_monthly(s, d)), goals(s)),
    "B10_detect_all": lambda s, d: _events(s, d).select("event_type", "type", "category", "month", "severity", F.bround("confidence", 6).alias("confidence"), "change_pct", "amount", "goal_name"),
    "B11_priority_score": lambda s, d: _events(s, d).select("event_type", "category", "month", "goal_name", "transaction_id", b.priority_score().alias("priority_score")),
    "B12_top_events": lambda s, d: b.prioritize(_events(s, d), 10).select("event_type", "category", "month", "goal_name", "transaction_id", "priority_score"),
    "B13_events_by": lambda s, d: b.events_by(_events(s, d), category="automobile", month="1995-03").select("event_type", "category", "month", "goal_name", "transaction_id"),
    "B14_summary": lambda s, d: b.summary(transactions(s, d), _events(s, d)),
    "B15_export": _export,
    "K1_kpis": lambda s, d: k.kpis(transactions(s, d)),
    "K2_spend_trend": lambda s, d: k.spend_trend(transactions(s, d)),
    "K2_spend_trend_wide": lambda s, d: k.spend_trend_wide(transactions(s, d), ["automobile", "building", "furniture", "household", "machinery"]),
    "K3_top_categories": lambda s, d: k.top_categories(transactions(s, d)),
    "K4_alert_counts": lambda s, d: k.alert_counts(_events(s, d)),
    "K5_filter": lambda s, d: k.filter_transactions(transactions(s, d), "building", "1995-03", "coffee|amzn").select("transaction_id", "merchant_raw", "category"),
    "K6_filtered_summary": lambda s, d: k.filtered_summary(k.filter_transactions(transactions(s, d), category="building")),
    "K6_amount_text": lambda s, d: transactions(s, d).select("transaction_id", k.amount_text(F.col("amount")).alias("amount_text")),
    "K8_savings_line": lambda s, d: k.savings_line(transactions(s, d)),
    "K9_goals_partition": lambda s, d: k.goals_partition(b.budget_goals(_monthly(s, d), goals(s))),
    "K10_colours": lambda s, d: _events(s, d).groupBy("severity").agg(F.count("*").alias("n")).select("severity", "n", k.severity_colour(F.col("severity")).alias("colour"), k.score_colour(F.col("n") / 20).alias("score")),
}

_TX = f"with tx as ({TRANSACTIONS}), goals as ({GOALS_SQL})"
_GRID = f"""{_TX},
sums as (select strftime(date, '%Y-%m') as month, category, cast(sum(amount) as double) as total from tx where category is not null group by all),
monthly as (select m.month, c.category, coalesce(s.total, 0.0::double) as total from (select distinct month from sums) m cross join (select distinct category from sums) c left join sums s using (month, category)),
rates0 as (select month, max(case when category = 'income' then total end) as income, round_even(abs(sum(case when category <> 'income' then total else 0.0 end)), 2) as expenses from monthly group by month),
rates as (select *, income - expenses as savings, coalesce((income - expenses) / nullif(income, 0), 0.0) as rate from rates0 where income is not null)"""


def _spikes(z: float, pct: float) -> str:
    return f"""select 'spending_spike' as type, category, month, round_even(s, 2) as current_amount, round_even(mean, 2) as baseline_amount, round_even((s - mean) / mean * 100, 1) as change_pct,
  round_even((s - mean) / sd, 2) as z_score, case when abs((s - mean) / sd) > 3 then 'high' else 'medium' end as severity, least(0.95, 0.7 + abs((s - mean) / sd) * 0.05) as confidence
from (select *, abs(total) as s, count(*) over w as n, avg(abs(total)) over w as mean, stddev_samp(abs(total)) over w as sd from monthly where category <> 'income'
      window w as (partition by category order by month rows between 3 preceding and 1 preceding))
where n >= 2 and sd > 0 and mean <> 0 and abs((s - mean) / sd) > {z} and abs((s - mean) / mean * 100) >= {pct} and abs(s - mean) >= 200"""


def _drift(pct: float) -> str:
    return f"""select 'category_drift' as type, category, month, round_even(r, 2) as rolling_avg_current, round_even(p, 2) as rolling_avg_previous, round_even(c, 1) as change_pct,
  case when c > 50 then 'high' else 'medium' end as severity, least(0.9, 0.6 + c / 100) as confidence
from (select *, lag(c) over (partition by category order by month) as c0 from (
  select *, case when p = 0 and r > 0 then 'inf'::double when p <> 0 then (r / p - 1) * 100 end as c from (
    select *, lag(r) over (partition by category order by month) as p from (
      select *, case when count(*) over w >= 2 then avg(abs(total)) over w end as r from monthly where category <> 'income'
      window w as (partition by category order by month rows between 2 preceding and current row)))))
where c > {pct} and c0 > 0"""


def _anomalies(multiplier: float) -> str:
    return f"""select 'anomaly' as type, category, transaction_id, strftime(date, '%Y-%m-%d') as date, strftime(date, '%Y-%m') as month, round_even(a, 2) as amount, merchant_raw as merchant,
  round_even(bound, 6) as upper_bound, case when bound > 0 then round_even((a - bound) / bound * 100, 1) else 0.0 end as exceeds_by_pct,
  case when a > q3 + 3 * iqr then 'high' else 'medium' end as severity, cast(case when a > q3 + 3 * iqr then 0.85 else 0.75 end as double) as confidence
from (select *, cast(abs(amount) as double) as a from tx) join
  (select category, quantile_cont(cast(abs(amount) as double), 0.75) as q3, quantile_cont(cast(abs(amount) as double), 0.75) - quantile_cont(cast(abs(amount) as double), 0.25) as iqr,
     quantile_cont(cast(abs(amount) as double), 0.75) + {multiplier} * (quantile_cont(cast(abs(amount) as double), 0.75) - quantile_cont(cast(abs(amount) as double), 0.25)) as bound
   from tx where category <> 'income' group by category having count(*) >= 4) using (category) where a > bound"""


_DROPS = """select 'savings_drop' as type, 'savings' as category, month, round_even(p * 100, 1) as savings_rate_previous, round_even(rate * 100, 1) as savings_rate_current,
  round_even(abs((rate - p) / p * 100), 1) as drop_pct, round_even(income, 2) as income, round_even(expenses, 2) as expenses, case when (rate - p) / p * 100 < -40 then 'high' else 'medium' end as severity,
  least(0.95, 0.7 + abs((rate - p) / p * 100) / 100) as confidence
from (select *, lag(rate) over (order by month) as p from rates) where p > 0 and (rate - p) / p * 100 < -20"""
_BUDGET = """select 'goal_status' as type, goal_name, category, month, budget_limit, round_even(abs(total), 2) as amount_spent, round_even(budget_limit - abs(total), 2) as remaining,
  round_even(abs(total) / budget_limit * 100, 1) as pct_used, case when abs(total) <= budget_limit then 'on_track' else 'exceeded' end as status,
  case when abs(total) / budget_limit * 100 > 100 then 'warning' when abs(total) / budget_limit * 100 > 80 then 'caution' else 'good' end as severity, 0.9::double as confidence
from monthly join (select goal_name, replace(replace(goal_name, '_budget', ''), '_', ' ') as category, "limit" as budget_limit from goals where goal_name like '%\\_budget%' escape '\\') using (category)"""
_SAVE = """select 'goal_status' as type, goal_name, month, round_even(t * 100, 1) as target_rate_pct, round_even(rate * 100, 1) as actual_rate_pct, round_even((t - rate) * 100, 1) as gap_pct,
  case when rate >= t then 'on_track' else 'below_target' end as status, case when rate < t * 0.5 then 'warning' when rate < t then 'caution' else 'good' end as severity, 0.9::double as confidence
from rates cross join (select goal_name, coalesce(target, 0.2::double) as t from goals where goal_name like 'savings_rate%')"""
_EVENTS = f"""{_GRID},
ev as (select 'spikes' as event_type, * from ({_spikes(1.8, 40)}) union all by name select 'drifts' as event_type, * from ({_drift(30)}) union all by name
  select 'anomalies' as event_type, * from ({_anomalies(1.5)}) union all by name select 'savings_drops' as event_type, * from ({_DROPS}) union all by name
  select 'goals' as event_type, * from ({_BUDGET}) union all by name select 'goals' as event_type, * from ({_SAVE})),
scored as (select *, round_even(coalesce(least(abs(change_pct) / 100, 2.0), least(drop_pct / 50, 2.0), least(amount / 500, 2.0), 0.5) * 0.4 + confidence * 0.3
  + case severity when 'high' then 1.0 when 'medium' then 0.6 when 'warning' then 0.8 when 'caution' then 0.5 when 'good' then 0.2 else 0.5 end * 0.2 + cast(month[6:7] as double) / 6.0 * 0.1, 3) as priority_score from ev)"""
_KPI = "select count(*) as transactions, coalesce(cast(sum(amount) filter (amount > 0) as double), 0) as income, coalesce(cast(abs(sum(amount) filter (amount < 0)) as double), 0) as expenses from"

_KPI_BY_MONTH = _KPI.replace("select ", "select strftime(date, '%Y-%m') as month, ", 1)

ORACLE_SQL: dict[str, str] = {
    "B0_month": f"{_TX} select strftime(date, '%Y-%m') as month, count(*) as n from tx group by 1",
    "B1_monthly_totals": f"{_GRID} select * from monthly",
    "B2_mom_change": f"""{_GRID} select month, category, round_even(case when p is null or (p = 0 and abs(total) = 0) then 0.0 when p = 0 then 'inf'::double else (abs(total) / p - 1) * 100 end, 4) as change_pct
        from (select *, lag(abs(total)) over (partition by category order by month) as p from monthly)""",
    "B3_spikes": f"{_GRID} select * replace (round_even(confidence, 6) as confidence) from ({_spikes(1.0, 10)})",
    "B4_drift": f"{_GRID} select * replace (round_even(confidence, 6) as confidence) from ({_drift(5)})",
    "B5_anomalies": f"{_TX} {_anomalies(0.5)}",
    "B6_savings_rate": f"{_GRID} select month, income, expenses, round_even(savings, 2) as savings, round_even(rate, 6) as savings_rate, round_even(rate * 100, 1) as savings_rate_pct from rates",
    "B7_savings_drops": f"{_GRID} select * replace (round_even(confidence, 6) as confidence) from ({_DROPS})",
    "B8_budget_goals": f"{_GRID} {_BUDGET}",
    "B8_unmatched_goals": f"{_TX} select goal_name, replace(replace(goal_name, '_budget', ''), '_', ' ') as category from goals where goal_name like '%\\_budget%' escape '\\' and replace(replace(goal_name, '_budget', ''), '_', ' ') not in (select category from tx)",
    "B9_savings_goals": f"{_GRID} {_SAVE}",
    "B10_detect_all": f"{_EVENTS} select event_type, type, category, month, severity, round_even(confidence, 6) as confidence, change_pct, amount, goal_name from ev",
    "B11_priority_score": f"{_EVENTS} select event_type, category, month, goal_name, transaction_id, priority_score from scored",
    "B12_top_events": f"""{_EVENTS} select event_type, category, month, goal_name, transaction_id, priority_score from scored
        order by priority_score desc, list_position(['spikes', 'drifts', 'anomalies', 'savings_drops', 'goals'], event_type), category nulls first, month, goal_name nulls first, transaction_id nulls first limit 10""",
    "B13_events_by": f"{_EVENTS} select event_type, category, month, goal_name, transaction_id from ev where category = 'automobile' and month = '1995-03'",
    "B14_summary": f"""{_EVENTS} select * from (select count(*) as total_transactions, cast(min(date) as varchar) as start, cast(max(date) as varchar) as "end", count(distinct category) as categories from tx),
        (select count(*) filter (event_type = 'spikes') as spikes, count(*) filter (event_type = 'drifts') as drifts, count(*) filter (event_type = 'anomalies') as anomalies,
         count(*) filter (event_type = 'savings_drops') as savings_drops, count(*) filter (event_type = 'goals') as goals from ev)""",
    "B15_export": f"""{_EVENTS}, top as (select *, row_number() over (order by priority_score desc, list_position(['spikes', 'drifts', 'anomalies', 'savings_drops', 'goals'], event_type),
        category nulls first, month, goal_name nulls first, transaction_id nulls first) as n from scored)
        select 'all_events' as section, null::bigint as n, event_type, category, month, goal_name, transaction_id, priority_score from scored
        union all select 'top_priorities', n, event_type, category, month, goal_name, transaction_id, priority_score from top where n <= 10
        union all select distinct 'categories_affected', null, null, category, null, null, null, null from ev where category is not null
        union all select 'total_events', count(*), null, null, null, null, null, null from ev""",
    "K1_kpis": f"{_TX} select *, income - expenses as net, case when income > 0 then round_even((income - expenses) / income * 100, 1) else 0.0 end as savings_pct from ({_KPI} tx)",
    "K2_spend_trend": f"""{_TX}, s as (select strftime(date, '%Y-%m') as month, category, cast(abs(sum(amount)) as double) as spent from tx where amount < 0 group by all)
        select month, category, coalesce(spent, 0.0) as spent from (select distinct month from s) cross join (select distinct category from s) left join s using (month, category)""",
    "K2_spend_trend_wide": f"""{_TX} select strftime(date, '%Y-%m') as month, {', '.join(f"coalesce(cast(abs(sum(amount) filter (category = '{c}')) as double), 0.0) as {c}" for c in ("automobile", "building", "furniture", "household", "machinery"))}
        from tx where amount < 0 group by 1""",
    "K3_top_categories": f"""{_TX}, s as (select category, cast(abs(sum(amount)) as double) as spent from tx where amount < 0 group by 1)
        select category, spent, least(100.0, round_even(spent / sum(spent) over () * 100, 1)) as share_pct from s order by spent desc, category limit 7""",
    "K4_alert_counts": f"{_EVENTS} select event_type, count(*) as n from ev group by 1",
    "K5_filter": f"{_TX} select transaction_id, merchant_raw, category from tx where category = 'building' and strftime(date, '%Y-%m') = '1995-03' and regexp_matches(merchant_raw, '(?i)coffee|amzn')",
    "K6_filtered_summary": f"""{_TX} select transactions, expenses as spent, income, '-$' || format('{{:,.2f}}', expenses) as spent_text, '+$' || format('{{:,.2f}}', income) as income_text from ({_KPI} tx where category = 'building')""",
    "K6_amount_text": f"{_TX} select transaction_id, '$' || case when amount < 0 then '-' else '+' end || format('{{:,.2f}}', cast(abs(amount) as double)) as amount_text from tx",
    "K8_savings_line": f"{_TX} select month, round_even(greatest(-100.0, least(100.0, coalesce((income - expenses) / nullif(income, 0) * 100, 0.0))), 4) as savings_pct from ({_KPI_BY_MONTH} tx group by 1)",
    "K9_goals_partition": f"""{_GRID} select goal_name, month, status, status = 'exceeded' as missed from (select *, row_number() over (partition by status = 'exceeded' order by month, goal_name) as r from ({_BUDGET}))
        where status = 'exceeded' or r <= 4""",
    "K10_colours": f"""{_EVENTS} select severity, count(*) as n, case severity when 'high' then 'red' when 'warning' then 'red' when 'medium' then 'amber' when 'caution' then 'amber' when 'good' then 'green' else 'blue' end as colour,
        case when count(*) / 20 > 0.8 then '#22c55e' when count(*) / 20 > 0.5 then '#f59e0b' else '#ef4444' end as score from ev group by 1""",
}
