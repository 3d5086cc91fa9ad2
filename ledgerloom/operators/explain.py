"""Explanations of events and matches: headline, body, evidence, confidence and action by template.

Where the body is a language model's, the request for it is a column; its text comes in as a column, and a fixed sentence stands in without one.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import round_binary, title

NO_MODEL = "AI explanation unavailable. Check the evidence below."


@dataclass(frozen=True)
class Texts:
    """Templates of one case; ``{name}`` is a field as text, ``{name|title}`` with capitals, ``{name:,.2f}`` a number,
    ``{name:.0%}`` a share. Without a body a model writes it, asked by ``request``."""

    headline: str
    evidence: str
    action: str
    confidence: float
    body: str | None = None
    request: str | None = None


_GOAL = "Goal: {goal_name} | Period: {month} | Status: {status}"
#: The texts of each kind of event, goals by their state.
TEXTS = {
    "spending_spike": Texts(
        "🔺 {category|title} spending up {abs_change:.0f}% in {month}",
        "Method: Z-score vs 3-month rolling average | Z-score: {z_score:.2f} | Baseline: ${baseline_amount:,.2f} | Current: ${current_amount:,.2f}",
        "Review {category} transactions for {month}", 0.85,
        request="The user's {category} spending in {month} was ${current_amount:.2f}, {abs_change:.0f}% above their usual ${baseline_amount:.2f} (Z-score: {z_score:.1f}). Explain and suggest one action."),
    "category_drift": Texts(
        "📊 {category|title} spending gradually increasing",
        "Method: 3-month rolling average | Previous avg: ${rolling_avg_previous:,.2f} | Current avg: ${rolling_avg_current:,.2f} | Change: +{change_pct:.0f}%",
        "Set a monthly budget for {category}", 0.80,
        request="The user's {category} 3-month rolling average rose {change_pct:.0f}% from ${rolling_avg_previous:.2f} to ${rolling_avg_current:.2f} as of {month}. This is a gradual upward trend. Explain and suggest one action."),
    "anomaly": Texts(
        "⚠️ Unusual {category} transaction — ${amount:,.2f} at {merchant}",
        "Method: IQR outlier detection | Amount: ${amount:,.2f} | Normal upper bound: ${upper_bound:,.2f} | Exceeds by: {exceeds_by_pct:.0f}%",
        "Verify this transaction in your bank statement", 0.85,
        request="A {category} transaction of ${amount:.2f} at {merchant} on {date} is {exceeds_by_pct:.0f}% above the normal upper limit of ${upper_bound:.2f} (IQR outlier detection). Explain and suggest one action."),
    "savings_drop": Texts(
        "💰 Savings rate dropped {drop_pct:.0f}% in {month}",
        "Previous rate: {savings_rate_previous:.1f}% | Current rate: {savings_rate_current:.1f}% | Income: ${income:,.2f} | Expenses: ${expenses:,.2f}",
        "Review your highest expense categories this month", 0.90,
        request="The user's savings rate dropped from {savings_rate_previous:.1f}% to {savings_rate_current:.1f}% in {month} (a {drop_pct:.0f}% drop). Income: ${income:,.2f}, Expenses: ${expenses:,.2f}. Explain what happened and suggest one concrete action."),
    "savings_met": Texts(
        "✅ Savings goal met in {month}", _GOAL, "Keep it up", 0.90,
        "Savings rate of {actual_rate_pct:.1f}% meets the {target_rate_pct:.0f}% target. Well done!"),
    "savings_missed": Texts("🎯 Savings goal missed in {month}", _GOAL, "Cut one discretionary category this month",
        0.90, request="The user's savings rate is {actual_rate_pct:.1f}% in {month}, short of their {target_rate_pct:.0f}% goal by {gap_pct:.1f} points. Give one specific suggestion."),
    "budget_exceeded": Texts("🚨 {category|title} budget exceeded in {month}", _GOAL,
        "Lower {category} spending next month", 0.90,
        request="The user spent ${amount_spent:.2f} on {category} in {month}, exceeding their ${budget_limit:.2f} budget by ${abs_remaining:.2f}. Suggest one way to prevent this next month."),
    "budget_almost_full": Texts(
        "⚡ {category|title} budget almost full in {month}", _GOAL, "Slow down {category} spending", 0.90,
        "${amount_spent:.2f} of ${budget_limit:.2f} used ({pct_used:.0f}%). Only ${remaining:.2f} remaining."),
    "budget_on_track": Texts(
        "✅ {category|title} budget on track in {month}", _GOAL, "No action needed", 0.90,
        "${amount_spent:.2f} of ${budget_limit:.2f} used ({pct_used:.0f}%). ${remaining:.2f} remaining."),
}
#: A budget is almost full above this share; what stands for missing fields; the texts of other events.
ALMOST_FULL_PCT = 80
DEFAULTS = {"category": "spending", "merchant": "Unknown", "goal_name": "goal", "status": "unknown", "month": "", "date": ""}
#: The request for any other event, with the first characters of its fields, and for a match.
OTHER_REQUEST, OTHER_LENGTH = "Explain this financial event in 2 sentences: ", 300
MATCH_REQUEST = (
    "Bank transaction {transaction_id} matched document {document_id} using {match_type} matching ({confidence:.0%} confidence). Scores: merchant {string_similarity:.0%}, "
    "amount {amount_match:.0%}, date {date_proximity:.0%}, document trust {document_trust:.0%}. Explain in one sentence for a non-technical user.")
#: Fields that are the size of another.
SIZES = {"abs_change": "change_pct", "abs_remaining": "remaining"}
OTHER = {"evidence": "See raw data", "action": "Review manually", "confidence": "N/A"}
_FIELD = re.compile(r"\{(\w+)(\|title)?(?::(,?)\.(\d)([f%]))?\}")


def render(template: str, text: Callable[[str], Column], number: Callable[[str], Column]) -> Column:
    """A template with its fields filled in; numbers are rounded by their exact value."""
    parts, at = [], 0
    for m in _FIELD.finditer(template):
        name, titled, comma, digits, kind = m.groups()
        if digits is not None:
            value = number(name) * 100 if kind == "%" else number(name)
            filled = F.format_string(f"%{comma}.{digits}f" + "%%" * (kind == "%"), round_binary(value, int(digits)))
        else:
            filled = title(text(name)) if titled else text(name)
        parts += [F.lit(template[at : m.start()]), filled]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def case_of(events: DataFrame) -> Column:
    """The key of ``TEXTS`` that an event's texts come from, null for other events."""
    c = F.col
    kind, used = c("type"), F.coalesce("pct_used", F.lit(0.0))
    saving = F.when(c("status") == "on_track", "savings_met").otherwise("savings_missed")
    budget = F.when(c("status") == "exceeded", "budget_exceeded").when(used > ALMOST_FULL_PCT,
        "budget_almost_full").otherwise("budget_on_track")
    goal = F.when(F.contains(F.coalesce("goal_name", F.lit("")), F.lit("savings_rate")), saving).otherwise(budget)
    return F.when(kind == "goal_status",
        goal).when(kind.isin(*(k for k in TEXTS if "_met" not in k and "_missed" not in k and "budget" not in k)), kind)


def explain_events(events: DataFrame, body: Column | None = None) -> DataFrame:
    """``events`` (of the detectors' common columns) with headline, body, request, evidence, confidence_text and action.

    ``request`` is what a model is to be asked for the body, null where a template has it. ``body`` is a model's text, used where the templates have none. Missing numbers are 0, other missing fields as in ``DEFAULTS``.
    """
    case, goal = case_of(events), F.col("type") == "goal_status"

    def text(name: str) -> Column:
        if name == "category":
            of_goal = F.replace(F.coalesce("goal_name", F.lit(DEFAULTS["goal_name"])), F.lit("_budget"), F.lit(""))
            return F.coalesce("category", F.when(goal, of_goal), F.lit(DEFAULTS["category"]))
        return F.coalesce(F.col(name).cast("string"), F.lit(DEFAULTS[name]))

    def number(name: str) -> Column:
        if name in SIZES:
            return F.abs(number(SIZES[name]))
        return F.coalesce(F.col(name).cast("double"), F.lit(20.0 if name == "target_rate_pct" else 0.0))

    def pick(part: str, otherwise: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for key, texts in TEXTS.items():
            template = getattr(texts, part)
            if template is not None:
                out = out.when(F.col("__case") == key, render(template, text, number))
        return out.otherwise(otherwise)

    sure = F.when(F.lit(False), F.lit(None).cast("double"))
    for key, texts in TEXTS.items():
        sure = sure.when(F.col("__case") == key, F.coalesce("confidence", F.lit(texts.confidence)))
    percent = F.concat(F.format_string("%.0f", F.bround(sure * 100, 0)), F.lit("%"))
    other = F.concat(F.lit(OTHER_REQUEST), F.substring(_fields(events.columns), 1, OTHER_LENGTH))
    model = F.coalesce(body, F.lit(NO_MODEL)) if body is not None else F.lit(NO_MODEL)
    return events.withColumn("__case", case).withColumns({
        "headline": pick("headline", title(F.replace(F.coalesce("type", F.lit("Event")), F.lit("_"), F.lit(" ")))),
        "body": pick("body", model), "evidence": pick("evidence", F.lit(OTHER["evidence"])),
        "action": pick("action", F.lit(OTHER["action"])),
        "request": F.when(F.col("__case").isNull(), other).otherwise(pick("request", F.lit(None).cast("string"))),
        "confidence_text": F.when(F.col("__case").isNotNull(), percent)
        .otherwise(F.coalesce(F.col("confidence").cast("string"), F.lit(OTHER["confidence"]))),
    }).drop("__case")


def _fields(names: list[str]) -> Column:
    """The fields that a row has, as JSON with a space after commas and colons; dates are text."""
    one = lambda n: F.regexp_replace(F.to_json(F.struct(F.col(f"`{n}`").alias("v"))), r'^\{"v":|\}$', "")
    parts = (F.when(F.col(f"`{n}`").isNotNull(), F.concat(F.lit(f'"{n}": '), one(n))) for n in names)
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def explain_match(matches: DataFrame) -> Column:
    """The request for a model's explanation of a match: t_id, d_id, match_type, confidence and the four scores of ``matches``; missing numbers are 0, a missing kind is unknown."""
    names = {"transaction_id": "t_id", "document_id": "d_id", "match_type": "match_type"}
    text = lambda n: F.coalesce(matches[names[n]].cast("string"), F.lit("UNKNOWN" if n == "match_type" else ""))
    return render(MATCH_REQUEST, text, lambda n: F.coalesce(matches[n].cast("double"), F.lit(0.0)))
