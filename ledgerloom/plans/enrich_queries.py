"""Queries of transaction enrichment and evaluation, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.rules import CATEGORIES, KEYWORDS, MERCHANT_FIRST
from ledgerloom.functions.text import alnum_id
from ledgerloom.operators import enrich as e
from ledgerloom.operators import evaluate as v
from ledgerloom.sources.tables import TRANSACTIONS, transactions

c = F.col


def _scored(s, d) -> DataFrame:
    """Transactions with clean names and a stand-in for a model's scores."""
    tx = transactions(s, d).withColumn("merchant_clean", e.clean_merchant(c("merchant_raw")))
    part = lambda a, b: F.pmod(c("ord") * a + b, F.lit(100)) / 100.0
    return tx.withColumn("scores", F.create_map(F.lit("groceries"), part(1, 0), F.lit("travel"), part(7, 3), F.lit("fees"), part(13, 5)))


def _decided(s, d, **how) -> DataFrame:
    tx = _scored(s, d)
    rule = e.rule_classify(c("merchant_raw"), c("merchant_clean"), c("description"))
    return tx.withColumn("rule", rule).withColumn("x", e.categorize(c("scores"), c("rule"), **how)).select("transaction_id", "x.*")


def _report_input(s, d) -> DataFrame:
    tx = transactions(s, d).select("transaction_id", "date", c("category").alias("category_hint"), F.pmod("ord", F.lit(37)).cast("string").alias("canonical_id"))
    return e.recurrence(tx).join(_decided(s, d), "transaction_id")


def _by_customer(s, d) -> DataFrame:
    orders = s.read.parquet(f"{d}/orders.parquet")
    return orders.select(c("o_orderkey").alias("transaction_id"), c("o_custkey").cast("string").alias("canonical_id"), c("o_orderdate").cast("date").alias("date"))


def _monthly_by_customer(s, d) -> DataFrame:
    """Rows at steady distances: three a customer, 30 days apart for some, 14 or 20 for others."""
    customer = s.read.parquet(f"{d}/customer.parquet").select(c("c_custkey").alias("k"))
    step = F.element_at(F.array(*map(F.lit, (30, 14, 20))), (c("k") % 3 + 1).cast("int"))
    n = (c("k") % 4).cast("int")
    return customer.select("k", F.explode(F.sequence(F.lit(0), n)).alias("i"), step.alias("step")).select(
        (c("k") * 10 + c("i")).alias("transaction_id"), c("k").cast("string").alias("canonical_id"), F.date_add(F.lit("2024-01-01").cast("date"), (c("i") * c("step")).cast("int")).alias("date"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "A1_clean_merchant": lambda s, d: transactions(s, d).select("transaction_id", e.clean_merchant(c("merchant_raw")).alias("merchant_clean")),
    "A1b_clean_first": lambda s, d: transactions(s, d).select("transaction_id", e.clean_merchant(c("merchant_raw"), "first").alias("merchant_clean")),
    "A1c_clean_draft": lambda s, d: transactions(s, d).select("transaction_id", e.clean_merchant(c("merchant_raw"), "draft").alias("merchant_clean")),
    "A2_extract_entity": lambda s, d: transactions(s, d).select("transaction_id", e.extract_entity(c("merchant_raw"), F.when(c("ord") % 2 == 0, c("category"))).alias("merchant_extracted")),
    "A2b_first_words": lambda s, d: transactions(s, d).select("transaction_id", e.first_words(c("merchant_raw")).alias("merchant_extracted")),
    "A3_A4_normalize": lambda s, d: _scored(s, d).withColumn("n", e.normalize_merchant(c("merchant_clean"), c("merchant_clean"))).select("transaction_id", c("n").alias("merchant_normalized"), alnum_id(c("n")).alias("normalized_id")),
    "A5_cluster_merchants": lambda s, d: e.cluster_merchants(_scored(s, d), column="merchant_clean"),
    "A6_rule_classify": lambda s, d: _scored(s, d).select("transaction_id", e.rule_classify(c("merchant_raw"), c("merchant_clean"), c("description")).alias("x")).select("transaction_id", "x.*"),
    "A6b_keywords_only": lambda s, d: _scored(s, d).select("transaction_id", e.rule_classify(c("merchant_raw"), c("merchant_clean"), c("description"), merchants={}).alias("x")).select("transaction_id", "x.*"),
    "A7_A8_categorize": _decided,
    "A8b_categorize_weak": lambda s, d: _decided(s, d, auto=0.9, suggested=0.8, weak=0.7),
    "A8c_A8d_bands": lambda s, d: _scored(s, d).select("transaction_id", e.confidence_band(c("scores")["travel"], 0.75, 0.5).alias("first_band"), e.confidence_band(c("scores")["travel"], 0.7, 0.5).alias("draft_band")),
    "A9_evidence": lambda s, d: _scored(s, d).select("transaction_id", e.category_evidence(c("merchant_clean"), c("scores")).alias("x")).select(
        "transaction_id", c("x.input_text").alias("input_text"), c("x.margin_to_second").alias("margin_to_second"), F.get("x.top_3", F.lit(0))["category"].alias("first"), F.get("x.top_3", F.lit(2))["score"].alias("third_score")),
    "A10_fingerprint": lambda s, d: transactions(s, d).select("transaction_id", e.fingerprint(c("amount"), c("date"), c("merchant_raw")).alias("fingerprint")),
    "A10b_fingerprint_draft": lambda s, d: transactions(s, d).select("transaction_id", e.fingerprint_draft(c("amount"), c("date"), c("category")).alias("fingerprint")),
    "A11_exact_duplicates": lambda s, d: e.exact_duplicates(transactions(s, d).withColumn("fingerprint", F.concat_ws("_", F.date_format("date", "yyyyMMdd"), "category", F.floor(F.abs("amount") / 100000).cast("string")))).select("transaction_id", "fingerprint", "copies"),
    "A12_recurrence": lambda s, d: e.recurrence(_monthly_by_customer(s, d)).select("transaction_id", "transaction_type"),
    "A12_recurrence_orders": lambda s, d: e.recurrence(_by_customer(s, d)).select("transaction_id", "transaction_type"),
    "A12b_recurrence_monthly": lambda s, d: e.recurrence(_monthly_by_customer(s, d), bands=((25, 35),)).select("transaction_id", "transaction_type"),
    "A12c_frequency": lambda s, d: e.frequency_label(_by_customer(s, d)),
    "A13_distribution": lambda s, d: e.distribution(_decided(s, d), "status"),
    "A14_hint_accuracy": lambda s, d: e.hint_accuracy(_report_input(s, d)),
    "A15_pattern_counts": lambda s, d: e.pattern_counts(transactions(s, d)),
    "A16_add_category": lambda s, d: _decided(s, d, allowed=(*CATEGORIES, "pets")),
    "A17_process": lambda s, d: e.process(transactions(s, d)).select("transaction_id", "merchant_canonical", "category", "status", "fingerprint", "transaction_type"),
    "E1_baseline_report": lambda s, d: v.baseline_report(_report_input(s, d)),
    "E1_low_categories": lambda s, d: v.low_confidence_categories(_report_input(s, d)),
    "E2_error_slices": lambda s, d: v.in_slices(_report_input(s, d)).select("slice", "transaction_id", "category", "confidence"),
}


def _title(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({x}), '[a-z]+|[^a-z]+'), lambda r: upper(r[1]) || r[2:]), '')"


def _sub(x: str, rules: list[tuple[str, str]]) -> str:
    for pattern, into in rules:
        x = f"regexp_replace({x}, '{pattern}', '{into}', 'g')"
    return x


def _squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _clean(variant: str) -> str:
    return _title(_squeeze(_sub("upper(trim(coalesce(merchant_raw, '')))", e.CLEANING[variant])))


_TX = f"with tx as ({TRANSACTIONS}), clean as (select *, {_clean('current')} as merchant_clean, (ord % 100) / 100.0 as s1, ((ord * 7 + 3) % 100) / 100.0 as s2, ((ord * 13 + 5) % 100) / 100.0 as s3 from tx)"
_TEXT = "lower(merchant_raw || ' ' || merchant_clean || ' ' || coalesce(description, ''))"


def _ruled(merchants: bool) -> str:
    n = {k: " + ".join(f"cast(contains(t, '{w}') as int)" for w in words) for k, words in KEYWORDS.items()}
    best = "list_sort([" + ", ".join(f"{{'n': -({x}), 'k': {k}, 'c': '{name}'}}" for k, (name, x) in enumerate(n.items())) + "])[1]"
    first = "case " + " ".join(f"when contains(t, '{k}') then '{k}'" for k in MERCHANT_FIRST) + " end" if merchants else "null::varchar"
    category = "case " + " ".join(f"when m = '{k}' then '{v}'" for k, v in MERCHANT_FIRST.items()) + " end"
    return f"""ruled as (select *, coalesce({category}, case when b.n < 0 then b.c end) as rc, cast(case when m is not null then 0.75 when b.n < 0 then round_even(least(0.6 + -b.n * 0.1, 0.85), 3) else 0 end as double) as rp,
      case when m is not null then 'merchant_first:' || m when b.n < 0 then 'keyword_match:' || b.c end as rr
    from (select *, {first} as m, {best} as b from (select *, {_TEXT} as t from clean)))"""


def _decision(auto: float, suggested: float, weak: float | None, allowed: tuple[str, ...] = CATEGORIES) -> str:
    weak_case = lambda x: f"when p >= {weak} then {x}" if weak is not None else ""
    ok = "rc in (" + ", ".join(f"'{x}'" for x in allowed) + ")"
    return f"""decided as (select transaction_id, case when p >= {weak if weak is not None else suggested} then top when {ok} then rc else top end as category,
      round_even(case when p >= {weak if weak is not None else suggested} then p when {ok} then rp else p end, 4) as confidence,
      case when p > {auto} then 'high' when p >= {suggested} then 'medium' {weak_case("'low'")} when {ok} then 'medium' else 'low' end as confidence_level,
      case when p > {auto} then 'auto-accepted' when p >= {suggested} then 'suggested' {weak_case("'suggested'")} when {ok} then 'fallback' else 'uncategorized' end as status,
      case when p >= {suggested} then 'zero-shot' {weak_case("'zero-shot-weak'")} when {ok} then 'fallback-rules' else 'zero-shot-failed' end as method
    from (select *, cast(greatest(s1, s2, s3) as double) as p, list_sort([{{'k': -s3, 'c': 'fees'}}, {{'k': -s1, 'c': 'groceries'}}, {{'k': -s2, 'c': 'travel'}}])[1].c as top from ruled))"""


def _recurring(source: str, bands: tuple[tuple[int, int], ...], cast_id: str = "") -> str:
    inside = " or ".join(f"bool_and(coalesce(gap between {a} and {b}, true))" for a, b in bands)
    return f"""select transaction_id, transaction_type from (select canonical_id, case when n >= 3 and steady then 'recurring' when n > 1 then 'repeat' else 'one-time' end as transaction_type
      from (select canonical_id, count(*) as n, {inside} as steady from (select *, date_diff('day', lag(date) over (partition by canonical_id order by date), date) as gap from {source}) group by 1)) join {source} using (canonical_id)"""


_STEADY = """with src as (select c_custkey * 10 + i as transaction_id, cast(c_custkey as varchar) as canonical_id, date '2024-01-01' + cast(i * [30, 14, 20][c_custkey % 3 + 1] as int) as date
  from (select c_custkey, unnest(range(0, c_custkey % 4 + 1)) as i from customer))"""
_ORDERS = "with src as (select o_orderkey as transaction_id, cast(o_custkey as varchar) as canonical_id, cast(o_orderdate as date) as date from orders)"
_RULED = f"{_TX}, {_ruled(True)}"
_DECIDED = f"{_RULED}, {_decision(0.7, 0.5, None)}"
_REPORT = f"""{_DECIDED}, src as (select transaction_id, date, category as category_hint, cast(ord % 37 as varchar) as canonical_id from tx),
rep as (select * from ({_recurring('src', ((25, 35), (13, 15)))}) join (select transaction_id, category_hint from src) using (transaction_id) join decided using (transaction_id))"""
_PATTERNS = ("SQ *", "TST*", "AMAZON", "UBER", "PAYPAL", "ONLINE PAYMENT")

ORACLE_SQL: dict[str, str] = {
    "A1_clean_merchant": f"{_TX} select transaction_id, merchant_clean from clean",
    "A1b_clean_first": f"{_TX} select transaction_id, {_clean('first')} as merchant_clean from tx",
    "A1c_clean_draft": f"{_TX} select transaction_id, {_squeeze(_sub('trim(merchant_raw)', e.CLEANING['draft']))} as merchant_clean from tx",
    "A2_extract_entity": f"{_TX} select transaction_id, case when ord % 2 = 0 then category else merchant_raw end as merchant_extracted from tx",
    "A2b_first_words": f"{_TX} select transaction_id, array_to_string(string_split({_squeeze('merchant_raw')}, ' ')[1:2], ' ') as merchant_extracted from tx",
    "A3_A4_normalize": f"""{_TX}, n as (select *, {_title(_squeeze("regexp_replace(merchant_clean, '[^a-zA-Z0-9 ]', ' ', 'g')"))} as t from clean), m as (select transaction_id, case when length(merchant_clean) > 3 and length(t) > 2 then t else merchant_clean end as merchant_normalized from n)
        select *, regexp_replace(lower(merchant_normalized), '[^a-z0-9]', '', 'g') as normalized_id from m""",
    "A6_rule_classify": f"{_RULED} select transaction_id, rc as category, rp as confidence, rr as rule from ruled",
    "A6b_keywords_only": f"{_TX}, {_ruled(False)} select transaction_id, rc as category, rp as confidence, rr as rule from ruled",
    "A7_A8_categorize": f"{_DECIDED} select * from decided",
    "A8b_categorize_weak": f"{_RULED}, {_decision(0.9, 0.8, 0.7)} select * from decided",
    "A8c_A8d_bands": f"{_TX} select transaction_id, case when s2 >= 0.75 then 'high' when s2 >= 0.5 then 'medium' else 'low' end as first_band, case when s2 >= 0.7 then 'high' when s2 >= 0.5 then 'medium' else 'low' end as draft_band from clean",
    "A9_evidence": f"""{_TX}, l as (select *, list_sort([{{'k': -s3, 'c': 'fees'}}, {{'k': -s1, 'c': 'groceries'}}, {{'k': -s2, 'c': 'travel'}}]) as x from clean)
        select transaction_id, merchant_clean as input_text, cast(round_even(x[2].k - x[1].k, 4) as double) as margin_to_second, x[1].c as first, cast(-x[3].k as double) as third_score from l""",
    "A10_fingerprint": f"{_TX} select transaction_id, format('{{:.2f}}', cast(abs(amount) as double)) || '_' || strftime(date, '%Y%m%d') || '_' || regexp_replace(lower(merchant_raw), '[^a-z0-9]', '', 'g') as fingerprint from tx",
    "A10b_fingerprint_draft": f"{_TX} select transaction_id, cast(abs(amount) as varchar) || '_' || strftime(date, '%Y%m%d') || '_' || category as fingerprint from tx",
    "A11_exact_duplicates": f"""{_TX} select * from (select transaction_id, fingerprint, count(*) over (partition by fingerprint) as copies from
        (select transaction_id, strftime(date, '%Y%m%d') || '_' || category || '_' || cast(cast(floor(abs(amount) / 100000) as bigint) as varchar) as fingerprint from tx)) where copies > 1""",
    "A12_recurrence": f"{_STEADY} {_recurring('src', ((25, 35), (13, 15)))}",
    "A12_recurrence_orders": f"{_ORDERS} {_recurring('src', ((25, 35), (13, 15)))}",
    "A12b_recurrence_monthly": f"{_STEADY} {_recurring('src', ((25, 35),))}",
    "A12c_frequency": f"{_ORDERS} select canonical_id, count(*) as n, case when count(*) > 3 then 'recurring' when count(*) > 1 then 'repeat' else 'one-time' end as frequency from src group by 1",
    "A13_distribution": f"{_DECIDED} select status as value, count(*) as n from decided group by 1",
    "A14_hint_accuracy": f"{_REPORT} select round_even(avg(cast(coalesce(category = category_hint, false) as int)), 4) as accuracy from rep",
    "A15_pattern_counts": f"{_TX} " + " union all ".join(f"select '{p}' as pattern, count(*) filter (regexp_matches(merchant_raw, '(?i){p}')) as n from tx" for p in _PATTERNS),
    "A16_add_category": f"{_RULED}, {_decision(0.7, 0.5, None, (*CATEGORIES, 'pets'))} select * from decided",
    "E1_baseline_report": f"""{_REPORT} select count(*) as total, round_even(avg(confidence), 4) as mean_confidence, round_even(avg(cast(coalesce(category = category_hint, false) as int)), 3) as accuracy,
        count(*) filter (not coalesce(category = category_hint, false)) as misclassified, count(*) filter (confidence_level = 'low') as low, count(*) filter (confidence_level = 'medium') as medium,
        count(*) filter (confidence_level = 'high') as high, count(*) filter (transaction_type = 'recurring') as recurring, count(*) filter (transaction_type = 'repeat') as repeat,
        count(*) filter (transaction_type = 'one-time') as one_time from rep""",
    "E1_low_categories": f"{_REPORT} select category, count(*) as n from rep where confidence_level = 'low' group by 1 order by n desc, category nulls first limit 5",
    "E2_error_slices": f"""{_REPORT} select confidence_level as slice, transaction_id, category, confidence from rep where confidence_level in ('high', 'low')
        union all select 'transfer', transaction_id, category, confidence from rep where category = 'transfer'""",
}
