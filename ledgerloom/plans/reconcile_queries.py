"""Queries of string similarity and reconciliation, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as x
from ledgerloom.functions.storage import discard, discard_others, written
from ledgerloom.functions.storage import materialize_lean as materialize
from ledgerloom.operators import dashboard, explain
from ledgerloom.operators import reconcile as r
from ledgerloom.sources.tables import RECON_DOCUMENTS, RECON_TRANSACTIONS, TRANSACTIONS, recon_inputs, transactions

c = F.col


def _tiers(s, d) -> DataFrame:
    return r.tiers(*recon_inputs(s, d))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("t_id", "d_id", "match_type", "status", "reason", F.bround("confidence", 4).alias("confidence"), F.bround("amount_discrepancy", 2).alias("amount_discrepancy"))


def _best(s, d) -> DataFrame:
    return r.best_match(_tiers(s, d))


def _open(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    tx, docs = recon_inputs(s, d)
    before = written(s)
    m = materialize(r.best_match(r.tiers(tx, docs)).select("t_id", "d_id", "confidence"), "matches")  # all that mismatches ask for
    m = discard_others(m, before)
    return r.unsupported(tx, m), r.unreconciled(docs, m), m


def _taken(found: DataFrame) -> DataFrame:
    """Each document that is somebody's best, once, with the largest confidence."""
    return materialize(found.groupBy("d_id").agg(F.max("confidence").alias("confidence")), "taken")


def _alone(s, d) -> DataFrame:
    """Documents without a transaction: what classes take says it, transactions are not listed."""
    tx, docs = recon_inputs(s, d)
    before = written(s)
    return r.unreconciled(docs, discard_others(_taken(r.best_classes(r.tiers(tx, docs))), before))


def _summary(s, d) -> DataFrame:
    lost, alone, m = _open(s, d)
    summary = r.mismatch_summary(lost, alone, m)
    discard(m)  # each kind's counts are written
    return summary


def _notes(s, d) -> DataFrame:
    """Transactions' side is written first, so that not both sides' rows are shuffled at once."""
    lost, _, m = _open(s, d)
    lost = materialize(lost.select("id", "amount", "merchant", "label"), "lost")
    taken = _taken(m)
    discard(m)
    return r.markers(lost, r.unreconciled(recon_inputs(s, d)[1], taken))


def _listed(s, d, tier: str, *names: str) -> DataFrame:
    return _rounded(r.listed_matches(r.listed_tiers(*recon_inputs(s, d), tier=tier, names_of=names), *names))


def _counted(s, d, tier: str, *names: str) -> DataFrame:
    """Matched pairs by class, for counts; trust decides no match, so classes need none."""
    tx, docs = recon_inputs(s, d)
    return r.class_matches(r.tiers(tx, docs.drop("trust_score"), tier=tier), *names)


def _names(s: SparkSession, d: str) -> DataFrame:
    """The distinct pairs of merchants of a transaction and the document of the same order."""
    tx, docs = recon_inputs(s, d)
    return tx.select("ord", c("merchant").alias("a")).join(docs.select("ord", c("merchant").alias("b")), "ord").select("a", "b").distinct()


def _total(s, d):
    return F.lit(s.read.parquet(f"{d}/orders.parquet").count())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "F1_indel_ratio": lambda s, d: _names(s, d).select("a", "b", F.bround(x.indel_ratio(c("a"), c("b")), 6).alias("ratio")),
    "F2_token_set_ratio": lambda s, d: _names(s, d).select("a", "b", F.bround(x.token_set_ratio(c("a"), c("b")), 6).alias("ratio")),
    "F3_name_similarity": lambda s, d: _names(s, d).select("a", "b", F.bround(x.name_similarity(c("a"), c("b")), 6).alias("ratio")),
    "F4_cosine": lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.bround(x.cosine(c("embedding"), F.reverse("embedding")), 6).alias("cosine")),
    "J1_J2_parse": lambda s, d: recon_inputs(s, d)[0].select("id", r.parse_amount(c("amount")).cast("double").alias("amount"), r.parse_date(c("date")).cast("date").cast("string").alias("date")),
    "J3_J6_names": lambda s, d: recon_inputs(s, d)[1].select("id", r.merchant_exact(c("merchant")).alias("m1"), r.merchant_fuzzy(c("merchant")).alias("m2"), r.merchant_semantic(c("merchant")).alias("m3"), r.expand_abbreviation(r.merchant_semantic(c("merchant"))).alias("x3")),
    "J7_exact": lambda s, d: _listed(s, d, "exact", "exact"),
    "J8_fuzzy": lambda s, d: _listed(s, d, "fuzzy", "fuzzy"),
    "J9_semantic": lambda s, d: _listed(s, d, "semantic", "semantic"),
    "J10_confidence": lambda s, d: recon_inputs(s, d)[1].select("id", F.bround(r.match_confidence(F.lit(0.9), F.lit(1.0), c("trust_score"), c("trust_score")), 6).alias("confidence")),
    "J11_cascade2": lambda s, d: _listed(s, d, "fuzzy", "exact", "fuzzy"),
    "J12_cascade3": lambda s, d: _listed(s, d, "semantic", "exact", "fuzzy", "semantic"),
    "J13_best_match": lambda s, d: _best(s, d).select("t_id", "d_id", "match_type", F.bround("confidence", 4).alias("confidence")),
    "J14_reconcile": lambda s, d: _rounded(r.assign(_tiers(s, d))),
    "J15_exact_batch": lambda s, d: _counted(s, d, "exact", "exact").groupBy("days").agg(F.sum("n").alias("n")),
    "J16_tier_stats": lambda s, d: r.tier_stats(_counted(s, d, "semantic", "exact", "fuzzy", "semantic"), _total(s, d)).withColumn("match_rate", F.bround("match_rate", 6)),
    "J17_J19_unsupported": lambda s, d: _open(s, d)[0].select("id", "reason", "label"),
    "J18_J20_unreconciled": lambda s, d: _alone(s, d).select("id", "reason", "label"),
    "J21_summary": _summary,
    "J22_markers": _notes,
    "J23_coverage": lambda s, d: (lambda u, v, m: r.coverage_stats(m, u, v))(*_open(s, d)).select("supported", "unsupported", "unreconciled", *(F.bround(k, 6).alias(k) for k in ("match_rate", "transaction_coverage", "document_coverage"))),
    "J24_evidence_chains": lambda s, d: r.evidence_chains(_best(s, d)).select("match_id", "transaction_id", "document_id", F.bround("confidence", 4).alias("confidence"), F.array_join("stages", ",").alias("stages")),
    "S6_load_transactions": lambda s, d: r.load_transactions(transactions(s, d)).select("id", "amount", "date", "merchant", "category"),
    "K7_recon_kpis": lambda s, d: dashboard.recon_kpis(_best(s, d), _total(s, d)).withColumn("match_rate", F.bround("match_rate", 6)),
    "B17_explain_match": lambda s, d: (lambda m: m.select("t_id", explain.explain_match(m).alias("prompt")))(_best(s, d)),
}


def _names_sql(prefixes: tuple[str, ...], start: str) -> str:
    import re

    for p in prefixes:
        pattern = "^" + re.escape(p).replace("\\ ", " ") + r"\s*"
        start = f"regexp_replace({start}, '{pattern}', '')"
    return start


def _sq(z: str) -> str:
    return rf"trim(regexp_replace({z}, '\s+', ' ', 'g'))"


def _fuzzy_name(z: str) -> str:
    z = _names_sql(r.FUZZY_PREFIXES, z)
    for suffix in r.SUFFIXES:
        z = f"trim(split_part({z}, '{suffix}', 1))"
    return _sq(z)


_LOW = "lower(coalesce(merchant, ''))"
_BOOK = "case regexp_replace(w, '[*-]', '', 'g') " + " ".join(f"when '{k}' then '{v}'" for k, v in r.EXPANSIONS.items()) + " else w end"
_EXPAND = f"array_to_string(list_transform(string_split(m3, ' '), lambda w: {_BOOK}), ' ')"
_NAMED = f"*, {_sq(_names_sql(r.EXACT_PREFIXES, _LOW))} as m1, {_fuzzy_name(_LOW)} as m2, {_sq(_names_sql(r.SEMANTIC_PREFIXES, _LOW))} as m3"
#: LCS of pairs by the table's rows: a cell is the larger of the cell above and, over earlier columns with the row's character, the cell above left plus 1.
_LCS = """dp as (select a, b, 0 as i, list_transform(range(length(b) + 1), lambda z: 0::bigint) as p from todo
  union all select a, b, i + 1, list_transform(range(length(b) + 1), lambda j: greatest(p[j + 1], coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda k: b[k] = a[i + 1]), lambda k: p[k] + 1)), 0))) from dp where i < length(a)),
lcs as (select a, b, case when length(a) + length(b) = 0 then 1.0 else 2 * p[length(b) + 1] / (length(a) + length(b))::double end as ratio from dp where i = length(a))"""
_TOKENS = """(select *, list_sort(list_distinct(list_intersect(ta, tb))) as i, list_sort(list_filter(ta, lambda w: not list_contains(tb, w))) as l, list_sort(list_filter(tb, lambda w: not list_contains(ta, w))) as rr
  from (select a, b, list_distinct(string_split(a, ' ')) as ta, list_distinct(string_split(b, ' ')) as tb from {src}))"""
_JOINED = "(select *, array_to_string(i, ' ') as core, array_to_string(i || l, ' ') as one, array_to_string(i || rr, ' ') as two from {tokens})"


def _set_ratio(src: str) -> tuple[str, str]:
    """SQL of the strings that a token-set ratio compares, and of the ratio from their LCS."""
    strings = _JOINED.format(tokens=_TOKENS.format(src=src))
    todo = f"select one as a, two as b from {strings} union select core, one from {strings} union select core, two from {strings}"
    ratio = f"""(select s.a, s.b, case when s.a = '' or s.b = '' then 0.0 when len(i) > 0 and (len(l) = 0 or len(rr) = 0) then 1.0 else greatest(x.ratio, case when len(i) > 0 then y.ratio else 0 end, case when len(i) > 0 then z.ratio else 0 end) end as ratio
      from {strings} s join lcs x on x.a = one and x.b = two join lcs y on y.a = core and y.b = one join lcs z on z.a = core and z.b = two)"""
    return todo, ratio


_FIXED = f"(select distinct x.merchant as a, y.merchant as b from ({RECON_TRANSACTIONS}) x join ({RECON_DOCUMENTS}) y using (ord))"
_SORTED = f"(select a as a0, b as b0, array_to_string(list_sort(string_split(a, ' ')), ' ') as a, array_to_string(list_sort(string_split(b, ' ')), ' ') as b from {_FIXED})"
_FIXED_TODO, _FIXED_SET = _set_ratio(_FIXED)
_PAIR_TODO, _PAIR_SET = _set_ratio("(select distinct t2 as a, d2 as b from cand)")

_INPUT = f"""t0 as ({RECON_TRANSACTIONS}), d0 as ({RECON_DOCUMENTS}), t1 as (select {_NAMED} from t0), d1 as (select {_NAMED} from d0),
t as (select *, {_EXPAND} as x3, cast(regexp_replace(amount, '[$,]', '', 'g') as decimal(18,4)) as amt, cast(date as date) as day from t1),
dd as (select *, {_EXPAND} as x3, cast(abs(amount) as decimal(18,4)) as amt, cast(date as date) as day from d1)"""
_SCORED = f"""with recursive {_INPUT},
cand as (select * from (select t.id as t_id, t.ord as t_ord, dd.id as d_id, dd.ord as d_ord, t.m1 as t1, dd.m1 as d1, t.m2 as t2, dd.m2 as d2, t.m3 as t3, dd.m3 as d3, t.x3 as tx, dd.x3 as dx, dd.trust_score as trust,
    abs(date_diff('day', t.day, dd.day)) as days, cast(abs(t.amt - dd.amt) as double) as diff, abs(round_even(t.amt, 2) - round_even(dd.amt, 2)) as cents,
    coalesce(cast(abs(t.amt - dd.amt) as double) / nullif(cast(greatest(t.amt, dd.amt) as double), 0), 0) as pct
  from t join dd on dd.day between t.day - 5 and t.day + 5 and dd.amt between t.amt * 0.94 - 6 and t.amt * 1.07 + 6) where days <= 5 and (diff <= 5 or pct <= 0.05)),
todo as (select distinct t1 as a, d1 as b from cand union select distinct tx, dx from cand union {_PAIR_TODO}),
{_LCS},
sc as (select cand.*, e.ratio as s1, f.ratio as s2, g.ratio as s3, case when diff <= 5 or pct <= 0.01 then 1 - least(pct / 0.01, 1.0) * 0.3 else 0.0 end as fa, case when pct <= 0.05 then 1 - pct / 0.05 * 0.4 else 0.0 end as sa
  from cand join lcs e on e.a = t1 and e.b = d1 join {_PAIR_SET} f on f.a = t2 and f.b = d2 join lcs g on g.a = tx and g.b = dx),
m as (select t_id, t_ord, d_id, d_ord, days, 0 as k, 'EXACT' as match_type, 'SUPPORTED' as status, null as reason, 0.4 * s1 + 0.3 + 0.2 + 0.1 * trust as confidence, null::double as amount_discrepancy, s1 as ss, 1.0::double as am, 1.0::double as dp, trust from sc where cents <= 0.01 and days <= 1 and s1 >= 0.9
  union all select t_id, t_ord, d_id, d_ord, days, 1, 'FUZZY', case when fa = 1 then 'SUPPORTED' else 'PARTIAL' end, case when diff <= 0.01 then null when diff <= 5 and pct > 0.01 then 'tip_adjustment' when pct <= 0.01 then 'currency_or_fee' end,
    0.4 * s2 + 0.3 * fa + 0.2 * (1 - days * 0.1) + 0.1 * trust, case when fa < 1 then round_even(diff, 2) end, s2, fa, (1 - days * 0.1)::double, trust from sc where fa >= 0.7 and days <= 3 and s2 >= 0.85
  union all select t_id, t_ord, d_id, d_ord, days, 2, 'SEMANTIC', case when sa >= 0.9 then 'SUPPORTED' else 'PARTIAL' end,
    case when regexp_matches(t3 || d3, '\\d') then 'ocr_correction' when tx <> t3 or dx <> d3 then 'abbreviation' when s3 >= 0.75 then 'rapidfuzz_fallback' else 'semantic_similarity' end,
    0.4 * s3 + 0.3 * sa + 0.2 * (1 - days * 0.08) + 0.1 * trust, case when sa < 1 then round_even(diff, 2) end, s3, sa, (1 - days * 0.08)::double, trust from sc where sa >= 0.6 and 1 - days * 0.08 >= 0.6 and s3 >= 0.65),
cas as (select * from m qualify row_number() over (partition by t_id, d_id order by k) = 1),
best as (select * from m qualify row_number() over (partition by t_id order by confidence desc, d_ord, k) = 1)"""
_OUT = "select t_id, d_id, match_type, status, reason, round_even(confidence, 4) as confidence, amount_discrepancy from"


def _any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


def _in(values: tuple[str, ...]) -> str:
    return "category in (" + ", ".join(f"'{v}'" for v in values) + ")"


_UNS = f"""select id, amount, merchant, case when {_any('merchant', r.DIGITAL)} then 'digital_purchase_no_receipt' when {_in(r.RECURRING_CATEGORIES)} then 'recurring_payment_no_receipt'
  when category = 'income' then 'income_deposit' when {_in(r.TRANSFER_CATEGORIES)} then 'transfer_or_fee' when {_any('merchant', r.CASH)} then 'cash_withdrawal' else 'no_document_found' end as reason,
  case when category = 'income' then 'Direct deposit' when {_in(r.LABEL_TRANSFERS)} then 'Bank transfer or fee' when {_any('merchant', r.CASH)} then 'Cash withdrawal' when {_any('merchant', r.SUBSCRIPTIONS)} then 'Digital subscription'
  when {_any('merchant', r.ONLINE)} then 'Online purchase' else 'Card transaction' end as label from t0 where id not in (select t_id from best where confidence >= 0.6)"""
_UNR = """select id, amount, merchant, case when trust_score < 0.5 then 'low_trust_document' when trust_score >= 0.8 then 'likely_cash_purchase' when doc_type = 'invoice' then 'unpaid_invoice' else 'no_transaction_found' end as reason,
  case when doc_type = 'invoice' then 'Unpaid invoice' when doc_type = 'statement' then 'Unmatched statement' when trust_score < 0.5 then 'Unverified document' else 'Possible cash purchase' end as label from d0 where id not in (select d_id from best where confidence >= 0.6)"""

ORACLE_SQL: dict[str, str] = {
    "F1_indel_ratio": f"with recursive todo as (select * from {_FIXED}), {_LCS} select a, b, round_even(ratio, 6) as ratio from lcs",
    "F2_token_set_ratio": f"with recursive todo as ({_FIXED_TODO}), {_LCS} select a, b, round_even(ratio, 6) as ratio from {_FIXED_SET}",
    "F3_name_similarity": f"""with recursive todo as (select * from {_FIXED} union select a, b from {_SORTED} union {_FIXED_TODO}), {_LCS}
        select p.a, p.b, round_even(greatest(x.ratio, y.ratio, z.ratio), 6) as ratio from {_FIXED} p join lcs x on x.a = p.a and x.b = p.b join {_SORTED} q on q.a0 = p.a and q.b0 = p.b join lcs y on y.a = q.a and y.b = q.b join {_FIXED_SET} z on z.a = p.a and z.b = p.b""",
    "F4_cosine": "select vec_id, round_even(list_cosine_similarity(embedding::double[], list_reverse(embedding)::double[]), 6) as cosine from embeddings",
    "J1_J2_parse": f"with {_INPUT} select id, cast(amt as double) as amount, cast(day as varchar) as date from t",
    "J3_J6_names": f"with {_INPUT} select id, m1, m2, m3, x3 from dd",
    "J7_exact": f"{_SCORED} {_OUT} m where k = 0",
    "J8_fuzzy": f"{_SCORED} {_OUT} m where k = 1",
    "J9_semantic": f"{_SCORED} {_OUT} m where k = 2",
    "J10_confidence": f"with {_INPUT} select id, round_even(0.4 * 0.9 + 0.3 + 0.2 * trust_score + 0.1 * trust_score, 6)::double as confidence from d0",
    "J11_cascade2": f"{_SCORED} {_OUT} cas where k < 2",
    "J12_cascade3": f"{_SCORED} {_OUT} cas",
    "J13_best_match": f"{_SCORED} select t_id, d_id, match_type, round_even(confidence, 4) as confidence from best",
    "J15_exact_batch": f"{_SCORED} select days, count(*) as n from m where k = 0 group by 1",
    "J16_tier_stats": f"""{_SCORED} select *, (select count(*) from t0) - matched as rejected, round_even(matched / (select count(*) from t0)::double, 6) as match_rate from (select count(*) as matched, count(*) filter (reason = 'tip_adjustment') as tip_adjustments,
        count(*) filter (reason = 'currency_or_fee') as currency_matches, count(*) filter (reason = 'abbreviation') as abbreviation_matches, count(*) filter (reason = 'ocr_correction') as ocr_error_matches from cas)""",
    "J17_J19_unsupported": f"{_SCORED} select id, reason, label from ({_UNS})",
    "J18_J20_unreconciled": f"{_SCORED} select id, reason, label from ({_UNR})",
    "J21_summary": f"""{_SCORED} select 'unsupported' as kind, reason, count(*) as n from ({_UNS}) group by 2 union all select 'unreconciled', reason, count(*) from ({_UNR}) group by 2
        union all select 'matches', case when confidence >= 0.6 then 'supported' else 'low_confidence' end, count(*) from best group by 2""",
    "J22_markers": f"""{_SCORED} select 'unsupported_spending' as type, id as transaction_id, null as document_id, label as user_label, '$' || format('{{:.2f}}', cast(regexp_replace(amount, '[$]', '') as double)) || ' at ' || merchant || ' — no receipt found' as story_note from ({_UNS})
        union all select 'unreconciled_receipt', null, id, label, 'Receipt from ' || merchant || ' ($' || format('{{:.2f}}', cast(amount as double)) || ') — no matching bank transaction' from ({_UNR})""",
    "J23_coverage": f"""{_SCORED}, n as (select (select count(*) from best) as supported, (select count(*) from ({_UNS})) as unsupported, (select count(*) from ({_UNR})) as unreconciled)
        select *, round_even(supported / (supported + unsupported)::double, 6) as match_rate, round_even(supported / (supported + unsupported)::double, 6) as transaction_coverage, round_even(supported / (supported + unreconciled)::double, 6) as document_coverage from n""",
    "J24_evidence_chains": f"{_SCORED} select substr(sha256(t_id || ':' || d_id), 1, 16) as match_id, t_id as transaction_id, d_id as document_id, round_even(confidence, 4) as confidence, 'reconcile_' || lower(match_type) as stages from best",
    "S6_load_transactions": f"with tx as ({TRANSACTIONS}) select transaction_id as id, cast(abs(amount) as varchar) as amount, cast(date as varchar) as date, merchant_raw as merchant, category from tx",
    "B17_explain_match": f"""{_SCORED} select t_id, 'Bank transaction ' || t_id || ' matched document ' || d_id || ' using ' || match_type || ' matching (' || format('{{:.0f}}', confidence * 100) || '% confidence). Scores: merchant '
        || format('{{:.0f}}', ss * 100) || '%, amount ' || format('{{:.0f}}', am * 100) || '%, date ' || format('{{:.0f}}', dp * 100) || '%, document trust ' || format('{{:.0f}}', cast(trust as double) * 100)
        || '%. Explain in one sentence for a non-technical user.' as prompt from best""",
    "K7_recon_kpis": f"""{_SCORED} select count(*) filter (match_type = 'EXACT') as exact, count(*) filter (match_type = 'FUZZY') as fuzzy, count(*) filter (match_type = 'SEMANTIC') as semantic, count(*) as matched,
        round_even(count(*) / (select count(*) from t0)::double, 6) as match_rate from best""",
}
