"""Queries of documents, evidence and trust; their SQL takes the values that were rendered into the texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import documents as o
from ledgerloom.operators import pixels as px
from ledgerloom.operators import trust as t
from ledgerloom.sources.tables import DOCUMENTS, documents

c = F.col
TODAY = "2024-07-01"


def _of(s, d, kind: str) -> DataFrame:
    return documents(s, d).where(c("doc_type") == kind).select("document_id", "raw_text", "ocr_confidence")


def _receipts(s, d):
    return o.receipt_facts(_of(s, d, "receipt"))


def _pick(s, d, **columns: Column) -> DataFrame:
    return documents(s, d).select("document_id", *(v.alias(k) for k, v in columns.items()))


def _chain(s, d) -> DataFrame:
    facts = _receipts(s, d).withColumn("conf", t.composite_confidence(c("ocr_confidence") / 100, c("extraction_confidence"), F.lit(0.92)))
    return t.explode_facts(facts.withColumn("item_count", F.size("items")), {"merchant": "merchant", "date": "date", "total_amount": "amount", "item_count": "item_count"}, "raw_text", "conf", 0.6)


def _trusted(s, d) -> DataFrame:
    f = _receipts(s, d)
    complete = t.completeness(F.lit("receipt"), [c(x).isNotNull() for x in ("merchant", "date", "total_amount")], [F.lit(False)], [F.lit(False)])
    consistent = t.consistency(F.to_date("date"), c("total_amount"), c("subtotal"), c("tax"), F.lit(TODAY).cast("date"))
    return f.select("document_id", complete.alias("completeness"), F.bround(consistent, 4).alias("consistency"), t.trust_score(F.lit(89.0), c("ocr_confidence"), complete, consistent).alias("x")).select("document_id", "completeness", "consistency", "x.*")


def _partial(s, d) -> DataFrame:
    return _receipts(s, d).select("document_id", t.partial_match_flag(c("raw_text"), c("subtotal"), c("tax"), c("total_amount")).alias("x"))


def _words() -> Column:
    return F.array(F.struct(F.lit("TOTAL").alias("text"), (c("document_id") % 100).alias("conf")), F.struct(F.lit("12.50").alias("text"), F.lit(80).cast("bigint").alias("conf")))

def _pixels(s, d) -> DataFrame:
    """Images of 20 by 20 pixels: one shade, with a darker half where the key is odd."""
    orders = s.read.parquet(f"{d}/orders.parquet").select(c("o_orderkey").alias("document_id"), (c("o_orderkey") % 200 + 56).alias("shade"))
    tone = lambda x: F.lpad(F.hex(x), 2, "0")
    data = F.unhex(F.concat(F.repeat(tone(c("shade")), 200), F.repeat(tone(F.when(c("document_id") % 2 == 1, 2).otherwise(c("shade"))), 200)))
    return orders.select("document_id", px.measure(data, F.lit(20), F.lit(20)).alias("x")).select("document_id", "x.*").drop("content_box").withColumn("laplacian_variance", F.bround("laplacian_variance", 6))


def _tiny_images(s, d) -> DataFrame:
    """Images of three by two pixels, turned, cut and levelled."""
    k = c("o_orderkey")
    data = F.unhex(F.concat(*(F.lpad(F.hex((k * i + i) % 256), 2, "0") for i in range(1, 7))))
    size = (F.lit(3), F.lit(2))
    rows = s.read.parquet(f"{d}/orders.parquet").select(k.alias("document_id"), data.alias("image"), (k % 4 * 90).cast("int").alias("degrees"))
    box = F.array(F.lit(1), F.lit(0), F.lit(1), F.lit(2))
    return rows.select("document_id", F.hex(px.turn("image", *size, "degrees")).alias("turned"), F.hex(px.crop("image", *size, box)).alias("cut"), F.hex(px.deskew("image", *size, F.lit(0.0))).alias("level"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "QS1_QS3_measures": lambda s, d: _pick(s, d, sharp=o.sharpness(c("width") * 1.0), clean=o.noise(c("noise") * 20, c("height")), contrast=F.bround(o.contrast(F.lit(10.0), c("width") / 4, c("contrast") / 4), 6)),
    "QS1_QS3_O1b_pixels": _pixels,
    "G2_pixels": _tiny_images,
    "QS4_quality_overall": lambda s, d: _pick(s, d, quality=o.quality_overall(c("sharpness"), c("noise"), c("contrast"), c("width") * c("height"))),
    "QS5_QS6_route": lambda s, d: documents(s, d).withColumn("q", o.quality_overall(c("sharpness"), c("noise"), c("contrast"), c("width") * c("height"))).select(
        "document_id", o.quality_route(c("q"), c("sharpness")).alias("route"), F.array_join(o.quality_recommendations(c("sharpness"), c("noise"), c("contrast"), c("width") / 1000), ",").alias("advice")),
    "G1_G3_geometry": lambda s, d: _pick(s, d, turn=o.orientation(c("width"), c("height")), skew=o.deskew_angle(c("document_id") % 13 / 2.0 - 3), steps=F.array_join(o.geometry_steps(o.orientation(c("width"), c("height")), o.deskew_angle(c("document_id") % 13 / 2.0 - 3), c("width") > 500), ",")),
    "O1_ocr_words": lambda s, d: _pick(s, d, x=o.words_text(_words())).select("document_id", "x.text", "x.confidence"),
    "O2_extract_simple": lambda s, d: _pick(s, d, x=o.extract_simple(c("raw_text"), c("ocr_confidence"))).select("document_id", "x.text", "x.confidence"),
    "O3_text_structure": lambda s, d: _pick(s, d, x=o.text_structure(c("raw_text"))).select("document_id", F.array_join("x.amounts", ",").alias("amounts"), F.array_join("x.dates", ",").alias("dates"), c("x.line_count").alias("line_count")),
    "C1_type_scores": lambda s, d: _pick(s, d, **{k: F.bround(o.type_score(c("raw_text"), w), 6) for k, w in o.TYPE_KEYWORDS.items()}),
    "C2_C3_layout": lambda s, d: _pick(s, d, tabular=o.table_like(c("raw_text")), x=o.layout_scores(c("raw_text"), c("width"), c("height"))).select("document_id", "tabular", c("x.receipt").alias("receipt"), F.bround("x.statement", 4).alias("statement"), F.bround("x.invoice", 4).alias("invoice")),
    "C4_C5_doc_type": lambda s, d: _pick(s, d, x=o.doc_type(c("raw_text"), c("width"), c("height"))).select("document_id", c("x.type").alias("type"), c("x.confidence").alias("confidence"), c("x.status").alias("status"), o.routing_decision(c("x.type"), c("x.confidence")).alias("route")),
    "R1_R5_receipt": lambda s, d: _receipts(s, d).select("document_id", "merchant", "date", "total_amount", "subtotal", "tax", "tax_rate"),
    "R6_receipt_items": lambda s, d: _receipts(s, d).select("document_id", F.explode("items").alias("x")).select("document_id", "x.quantity", "x.name", "x.price"),
    "R7_R8_payment_confidence": lambda s, d: _receipts(s, d).select("document_id", "payment_method", "extraction_confidence"),
    "R9_receipt_json": lambda s, d: _receipts(s, d).select("document_id", F.to_json(o.receipt_record()).alias("json")),
    "ST1_ST4_statement": lambda s, d: o.statement_facts(_of(s, d, "statement")).select("document_id", "account_holder", c("statement_period.start").alias("start"), c("statement_period.end").alias("end"), "beginning_balance", "ending_balance"),
    "ST5_statement_rows": lambda s, d: o.statement_facts(_of(s, d, "statement")).select("document_id", F.explode("transactions").alias("x")).select("document_id", "x.*"),
    "ST6_confidence": lambda s, d: o.statement_facts(_of(s, d, "statement")).select("document_id", "extraction_confidence"),
    "I1_I4_invoice": lambda s, d: o.invoice_facts(_of(s, d, "invoice")).select("document_id", "invoice_number", "vendor", "client", "invoice_date", "due_date"),
    "I5_line_items": lambda s, d: o.invoice_facts(_of(s, d, "invoice")).select("document_id", F.explode("line_items").alias("x")).select("document_id", "x.*"),
    "I6_I7_totals": lambda s, d: o.invoice_facts(_of(s, d, "invoice")).select("document_id", "subtotal", "tax", "tax_rate", "total_due", "payment_terms", "extraction_confidence"),
    "P1_P2_kind": lambda s, d: _pick(s, d, kind=o.transaction_type(c("doc_type"), c("raw_text")), x=o.mock_categorize(c("doc_type"), c("raw_text")), signed=o.signed_amount(o.transaction_type(c("doc_type"), c("raw_text")), c("total"))).select("document_id", "kind", "x.category", "x.confidence", c("signed").cast("double").alias("signed")),
    "P3_P4_final": lambda s, d: _pick(s, d, final=o.final_confidence(c("sharpness"), c("contrast")), status=o.final_status(o.final_confidence(c("sharpness"), c("contrast")), c("contrast"), c("sharpness"))),
    "P5_P6_process": lambda s, d: o.process_documents(documents(s, d).select("document_id", "doc_type", "raw_text", F.lit(0.0).alias("ocr_confidence"))).select("document_id", "doc_type", "merchant", "date", "amount", "category", "transaction_type", "status"),
    "P7_preprocess": lambda s, d: o.preprocess(documents(s, d).drop("doc_type").withColumns({
        "skew_angle": c("document_id") % 13 / 2.0 - 3, "cropped": c("width") > 500, "load_error": F.when(c("document_id") % 50 == 0, "broken")})).select(
        "document_id", "route", "error", "status", "doc_type", "type_status", "strategy", F.array_join("preprocessing_applied", ",").alias("applied"), "orientation_angle", "skew_angle",
        F.array_join("structure.amounts", ",").alias("amounts"), F.array_join("structure.dates", ",").alias("dates"), "structure.line_count"),
    "V1_V2_evidence": lambda s, d: _pick(s, d, conf=t.composite_confidence(c("sharpness"), c("contrast"), F.lit(0.9)), status=t.evidence_status(c("sharpness")), strict=t.evidence_status(c("sharpness"), 0.5)),
    "V3_V4_chains": lambda s, d: _chain(s, d).select("document_id", "field", "value", "confidence", "status"),
    "V5_needs_review": lambda s, d: t.needs_review(_chain(s, d)).select("document_id", "field", "place"),
    "V6_evidence_report": lambda s, d: t.evidence_report(_chain(s, d)),
    "T1_T4_trust": _trusted,
    "D1_fingerprint": lambda s, d: _pick(s, d, fingerprint=t.content_fingerprint(c("raw_text"))),
    "D2_duplicates": lambda s, d: t.duplicate_flags(documents(s, d), "document_id", "raw_text").select("document_id", "is_duplicate"),
    "D2_duplicates_texts": lambda s, d: t.duplicate_flags(s.read.parquet(f"{d}/documents.parquet"), "doc_id", "text").select("doc_id", "fingerprint", "is_duplicate"),
    "D3_seen_count": lambda s, d: t.seen_count(documents(s, d), "raw_text"),
    "M1_partial_match": lambda s, d: _partial(s, d).select("document_id", "x.*"),
    "M2_explanation": lambda s, d: _partial(s, d).select("document_id", t.partial_explanation(c("x")).alias("explanation")),
    "X1_enhanced": lambda s, d: o.enhanced(o.preprocess(documents(s, d).drop("doc_type")).where("error is null"), F.lit(TODAY).cast("date")).select(
        "document_id", "doc_type", "merchant", "description", "date", "amount", "completeness", F.bround("consistency", 4).alias("consistency"), c("confidence").alias("trust_score"), "status", c("partial.reason").alias("reason"),
        c("chain.field").alias("fact"), c("chain.value").alias("value"), c("chain.confidence").alias("evidence")),
}

_D = f"with docs as ({DOCUMENTS})"
_R, _S, _I = (f"{_D}, x as (select *, sub::double as subd, tax::double as taxd, total::double as totald from docs where doc_type = '{k}')" for k in ("receipt", "statement", "invoice"))
_Q = "round_even(0.4 * sharpness + 0.25 * noise + 0.25 * contrast + 0.1 * least(width * height / 1e6, 1.0), 4)"
_SKEW = "document_id % 13 / 2.0 - 3"
_TURN = "case when width / height > 1.3 then 90 else 0 end"


def _score(words: tuple[str, ...]) -> str:
    h = " + ".join(f"cast(contains(lower(raw_text), '{w}') as int)" for w in words)
    u = " + ".join(f"cast(contains(lower(raw_text), '{w}') as int)" for w in dict.fromkeys(words))
    return f"(({h}) / {len(words)}::double * 3 * (0.5 + 0.5 * coalesce(({u})::double / nullif({h}, 0), 0)))"


_LAYOUT = """lay as (select *, tab, case when width / height between 0.5 and 0.8 and height > width then 0.5 else 0.0 end as lr, case when width / height between 0.7 and 1.0 and contains(lower(raw_text), 'statement') then 0.8 else 0.0 end + case when tab then 0.3 else 0.0 end as ls,
  case when contains(lower(raw_text), 'invoice') then 1.0 else 0.0 end + case when tab then 0.4 else 0.0 end as li
  from (select *, len(list_filter(string_split(raw_text, chr(10)), lambda x: len(regexp_extract_all(x, '\\$?\\d+\\.?\\d*')) >= 2)) / len(string_split(raw_text, chr(10)))::double > 0.3 as tab from docs))"""
_TYPE = f"""{_D}, {_LAYOUT}, sc as (select *, {_score(o.TYPE_KEYWORDS['receipt'])} + 0.3 * lr as s1, {_score(o.TYPE_KEYWORDS['statement'])} + 0.3 * ls as s2, {_score(o.TYPE_KEYWORDS['invoice'])} + 0.3 * li as s3 from lay),
typed as (select *, least(greatest(s1, s2, s3) / 2, 1.0) as conf, case when s1 >= s2 and s1 >= s3 then 'receipt' when s2 >= s3 then 'statement' else 'invoice' end as best,
  greatest(s1, s2, s3) - list_sort([s1, s2, s3])[2] as margin from sc)"""
_ROUTE = "case when conf < 0.4 then 'manual_review' when best = 'receipt' then 'key_value_extraction' when best = 'statement' then 'table_extraction' else 'structured_parsing' end"
_CHAIN = f"""{_R}, ch as (select document_id, field, value, conf as confidence, case when conf >= 0.6 then 'verified' when conf >= 0.5 then 'low_confidence' else 'manual_review' end as status from (
  select document_id, round_even(ocr_confidence / 100 * 0.8 * 0.92, 4) as conf, unnest(['merchant', 'date', 'amount', 'item_count']) as field, unnest(['Trader Joes', iso, cast(totald as varchar), '2']) as value from x))"""
_FP = r"""substr(md5(coalesce(nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(raw_text, '\$\d+\.\d{2}'))), ','), ''), 'no_amounts') || ':' ||
  coalesce(nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(raw_text, '\d{1,2}/\d{1,2}/\d{2,4}'))), ','), ''), 'no_dates') || ':' ||
  coalesce(lower(substr(list_filter(list_transform(string_split(raw_text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 2)[1], 1, 30)), '')), 1, 16)"""



def _half_even(x: str) -> str:
    """Rounding to four places, half to even, of a number's decimal form: in whole numbers, as ties are no binary fractions."""
    n = f"cast(round(({x}) * 1e10) as bigint)"
    return f"(({n} // 1000000 + case when {n} % 1000000 > 500000 or ({n} % 1000000 = 500000 and {n} // 1000000 % 2 = 1) then 1 else 0 end) / 10000.0)"


ORACLE_SQL: dict[str, str] = {
    "QS1_QS3_measures": f"{_D} select document_id, least(width * 1.0 / 500, 1.0)::double as sharp, case when height < 100 then 0.5 else 1 - least(noise * 20 / 20, 1.0) end as clean, round_even(case when contrast / 4 > 0.15 then 0.3 else greatest(0.1, least(1.0, (width / 4.0 - 10.0) / 150)) end::double, 6) as contrast from docs",
    "QS1_QS3_O1b_pixels": """select o_orderkey as document_id, cast(case when o_orderkey % 2 = 0 or 4 * (shade - 2) < 50 then 400 else 360 end as bigint) as flat_pixels,
        cast(case when o_orderkey % 2 = 0 then 0 else (shade - 2) / 2.0 end as double) as flat_deviation, cast(case when o_orderkey % 2 = 1 then 2 else shade end as int) as low, cast(shade as int) as high,
        cast(case when o_orderkey % 2 = 1 then 0.5 else 0 end as double) as black_share,
        round_even(case when o_orderkey % 2 = 1 then (shade - 2) * (shade - 2) / 10.0 else 0 end::double, 6) as laplacian_variance from (select o_orderkey, o_orderkey % 200 + 56 as shade from orders)""",
    "G2_pixels": """select document_id, case document_id % 4 when 0 then a || b || c || d || e || f when 1 then c || f || b || e || a || d when 2 then f || e || d || c || b || a else d || a || e || b || f || c end as turned,
        b || e as cut, a || b || c || d || e || f as level from (select o_orderkey as document_id, lpad(hex((o_orderkey * 1 + 1) % 256), 2, '0') as a, lpad(hex((o_orderkey * 2 + 2) % 256), 2, '0') as b, lpad(hex((o_orderkey * 3 + 3) % 256), 2, '0') as c, lpad(hex((o_orderkey * 4 + 4) % 256), 2, '0') as d, lpad(hex((o_orderkey * 5 + 5) % 256), 2, '0') as e, lpad(hex((o_orderkey * 6 + 6) % 256), 2, '0') as f from orders)""",
    "QS4_quality_overall": f"{_D} select document_id, {_Q} as quality from docs",
    "QS5_QS6_route": f"""{_D} select document_id, case when {_Q} >= 0.7 and sharpness >= 0.6 then 'direct_ocr' when {_Q} >= 0.4 then 'enhance_then_ocr' else 'reject_or_manual' end as route,
        concat_ws(',', case when sharpness < 0.5 then 'sharpen' end, case when noise < 0.6 then 'denoise' end, case when contrast < 0.5 then 'contrast_enhance' end, case when width / 1000.0 < 0.3 then 'upscale' end) as advice from docs""",
    "G1_G3_geometry": f"""{_D}, g as (select *, {_TURN} as turn, cast(case when abs({_SKEW}) < 0.5 or abs({_SKEW}) > 5 then 0.0 else {_SKEW} end as double) as skew from docs)
        select document_id, turn, skew, concat_ws(',', case when turn <> 0 then 'rotate_' || turn end, case when skew <> 0 then 'deskew' end, case when width > 500 then 'crop' end) as steps from g""",
    "O1_ocr_words": f"{_D} select document_id, case when document_id % 100 > 30 then 'TOTAL 12.50' else '12.50' end as text, case when document_id % 100 > 30 then (document_id % 100 + 80) / 2.0 else 80.0 end::double as confidence from docs",
    "O2_extract_simple": f"{_D} select document_id, replace(raw_text, chr(10), ' ') as text, ocr_confidence / 100 as confidence from docs",
    "O3_text_structure": rf"""{_D} select document_id, array_to_string(regexp_extract_all(raw_text, '\$?\d+\.\d{{2}}')[1:10], ',') as amounts, array_to_string(regexp_extract_all(raw_text, '\d{{1,2}}/\d{{1,2}}/\d{{2,4}}')[1:5], ',') as dates,
        len(string_split(raw_text, chr(10))) as line_count from docs""",
    "C1_type_scores": f"{_D} select document_id, " + ", ".join(f"round_even({_score(w)}, 6) as {k}" for k, w in o.TYPE_KEYWORDS.items()) + " from docs",
    "C2_C3_layout": f"{_D}, {_LAYOUT} select document_id, tab as tabular, lr::double as receipt, round_even(ls::double, 4) as statement, round_even(li::double, 4) as invoice from lay",
    "C4_C5_doc_type": f"""{_TYPE} select document_id, case when conf >= 0.4 then best else 'unknown' end as type, round_even(conf, 4) as confidence,
        case when conf >= 0.7 and margin > 0.3 then 'high_confidence' when conf >= 0.4 then 'medium_confidence' else 'low_confidence' end as status, {_ROUTE} as route from typed""",
    "R1_R5_receipt": f"{_R} select document_id, 'Trader Joes' as merchant, iso as date, totald as total_amount, subd as subtotal, taxd as tax, 6.0::double as tax_rate from x",
    "R6_receipt_items": f"{_R} select document_id, 2 as quantity, 'Greek Yogurt' as name, subd as price from x union all select document_id, 1, 'Organic Bananas', 1.29::double from x",
    "R7_R8_payment_confidence": f"{_R} select document_id, case when document_id % 2 = 0 then 'DEBIT' else 'VISA' end as payment_method, 0.8::double as extraction_confidence from x",
    "R9_receipt_json": f"""{_R} select document_id, '{{"merchant":"Trader Joes","date":"' || iso || '","total_amount":' || totald || ',"subtotal":' || subd || ',"tax":' || taxd || ',"tax_rate":6.0,"items":[{{"quantity":2,"name":"Greek Yogurt","price":'
        || subd || '}},{{"quantity":1,"name":"Organic Bananas","price":1.29}}],"payment_method":"' || case when document_id % 2 = 0 then 'DEBIT' else 'VISA' end || '","extraction_confidence":0.8}}' as json from x""",
    "ST1_ST4_statement": f"""{_S} select document_id, 'John Doe' as account_holder, '2024-01-01' as start, '2024-01-31' as "end", subd as beginning_balance, totald as ending_balance from x""",
    "ST5_statement_rows": f"""{_S} select document_id, iso as date, 'GROCERY STORE #' || store as description, taxd as amount, 'debit' as transaction_type, subd as balance from x
        union all select document_id, iso, 'DIRECT DEPOSIT', subd, 'credit', totald from x""",
    "ST6_confidence": f"{_S} select document_id, 0.76::double as extraction_confidence from x",
    "I1_I4_invoice": f"{_I} select document_id, 'INV-2024-' || store as invoice_number, 'Acme Supplies Ltd' as vendor, 'Client Corp ' || store as client, iso as invoice_date, '2025-12-31' as due_date from x",
    "I5_line_items": f"{_I} select document_id, 'Widget' as description, 2 as quantity, taxd as unit_price, subd as amount from x",
    "I6_I7_totals": f"{_I} select document_id, subd as subtotal, taxd as tax, 6.0::double as tax_rate, totald as total_due, 'Net 30' as payment_terms, 0.88::double as extraction_confidence from x",
    "P1_P2_kind": f"""{_D}, x as (select *, lower(doc_type || ' ' || raw_text) as t from docs), y as (select *, case when {' or '.join(f"contains(t, '{w}')" for w in o.INCOME_WORDS)} then 'income' when {' or '.join(f"contains(t, '{w}')" for w in o.TRANSFER_WORDS)} then 'transfer' else 'expense' end as kind,
        case {' '.join("when " + " or ".join(f"contains(t, '{w}')" for w in ws) + f" then '{k}'" for k, ws in o.MOCK.items())} else 'other' end as category from x)
        select document_id, kind, category, case when category = 'other' then 0.5 else 0.75 end::double as confidence, case when kind = 'expense' then -total else total end::double as signed from y""",
    "P3_P4_final": f"""{_D}, f as (select *, round_even(0.6 * sharpness + 0.4 * contrast, 4) as final from docs)
        select document_id, final, case when contrast < 0.25 or sharpness < 0.4 then 'manual_review' when final >= 0.6 then 'verified' when final >= 0.45 then 'low_confidence' else 'manual_review' end as status from f""",
    "P5_P6_process": f"""{_D}, x as (select *, sub::double as s, tax::double as tx, total::double as tt from docs)
        select document_id, doc_type, 'Trader Joes' as merchant, iso as date, tt as amount, 'food' as category, 'expense' as transaction_type, 'verified' as status from x where doc_type = 'receipt'
        union all select document_id, doc_type, 'GROCERY STORE', iso, tx, 'food', 'expense', 'verified' from x where doc_type = 'statement'
        union all select document_id, doc_type, 'DIRECT DEPOSIT', iso, s, 'income', 'income', 'verified' from x where doc_type = 'statement'
        union all select document_id, doc_type, 'Acme Supplies Ltd', iso, tt, 'other', 'expense', 'verified' from x where doc_type = 'invoice'""",
    "P7_preprocess": f"""{_TYPE}, q as (select *, {_Q} as q from typed), r as (select *, case when q >= 0.7 and sharpness >= 0.6 then 'direct_ocr' when q >= 0.4 then 'enhance_then_ocr' else 'reject_or_manual' end as route from q),
        e as (select *, case when document_id % 50 = 0 then 'load_failed' when width < 200 or height < 200 then 'validation_failed' when q < 0.3 or route = 'reject_or_manual' then 'quality_too_low' end as error from r),
        g as (select *, case when error is null then {_TURN} end as turn, case when error is null then case when abs({_SKEW}) < 0.5 or abs({_SKEW}) > 5 then 0.0 else {_SKEW} end end::double as skew from e)
        select document_id, route, error, case when error is null then 'success' else 'error' end as status, case when error is null then case when conf >= 0.4 then best else 'unknown' end end as doc_type,
        case when error is null then case when conf >= 0.7 and margin > 0.3 then 'high_confidence' when conf >= 0.4 then 'medium_confidence' else 'low_confidence' end end as type_status,
        case when error is null then {_ROUTE} else 'generic_ocr' end as strategy, turn as orientation_angle, skew as skew_angle,
        case when error is null then concat_ws(',', case when sharpness < 0.5 then 'sharpen' end, case when noise < 0.6 then 'denoise' end, case when contrast < 0.5 then 'contrast_enhance' end, case when least(width * height / 1e6, 1.0) < 0.3 then 'upscale' end,
          case when turn <> 0 then 'rotate_' || turn end, case when skew <> 0 then 'deskew' end, case when width > 500 then 'crop' end) end as applied,
        case when error is null then array_to_string(regexp_extract_all(raw_text, '\\$?\\d+\\.\\d{{2}}')[1:10], ',') end as amounts, case when error is null then array_to_string(regexp_extract_all(raw_text, '\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}}')[1:5], ',') end as dates,
        case when error is null then len(string_split(raw_text, chr(10))) end as line_count from g""",
    "V1_V2_evidence": f"""{_D} select document_id, round_even(sharpness * contrast * 0.9, 4) as conf, case when sharpness >= 0.7 then 'verified' when sharpness >= 0.5 then 'low_confidence' else 'manual_review' end as status,
        case when sharpness >= 0.5 then 'verified' else 'manual_review' end as strict from docs""",
    "V3_V4_chains": f"{_CHAIN} select * from ch",
    "V5_needs_review": f"{_CHAIN} select document_id, field, case when status = 'manual_review' then 0 else 1 end as place from ch where status <> 'verified'",
    "V6_evidence_report": f"{_CHAIN} select count(distinct document_id) as documents, count(*) as facts, count(*) filter (status = 'verified') as verified, count(*) filter (status = 'low_confidence') as low_confidence, count(*) filter (status = 'manual_review') as manual_review from ch",
    "T1_T4_trust": f"""{_R}, y as (select *, case when iso > '{TODAY}' then 0.7 else 1.0 end::double as con, case when ocr_confidence > 1 then ocr_confidence / 100 else ocr_confidence end as ocr from x),
        z as (select *, 0.89 * 0.3 + ocr * 0.3 + 1.0 * 0.2 + con * 0.2 as raw from y)
        select document_id, 1.0::double as completeness, con as consistency, {_half_even('raw')} as trust_score, 0.89::double as image_quality, round_even(ocr, 4) as ocr_confidence, case when raw >= 0.75 then 'verified' when raw >= 0.5 then 'low_confidence' else 'manual_review' end as status from z""",
    "D1_fingerprint": f"{_D} select document_id, {_FP} as fingerprint from docs",
    "D2_duplicates": f"{_D} select document_id, row_number() over (partition by {_FP} order by document_id) > 1 as is_duplicate from docs",
    "D2_duplicates_texts": f"select doc_id, fingerprint, row_number() over (partition by fingerprint order by doc_id) > 1 as is_duplicate from (select doc_id, {_FP} as fingerprint from (select doc_id, text as raw_text from documents))",
    "D3_seen_count": f"{_D} select count(distinct {_FP}) as seen from docs",
    "M1_partial_match": f"""{_R} select document_id, document_id % 7 = 0 as eligible, case when document_id % 7 = 0 then 'tip_detected' end as reason, case when document_id % 7 = 0 then 0.05 else 0.0 end::double as confidence_penalty,
        case when document_id % 7 = 0 then 0.2 else 0.0 end::double as suggested_tolerance from x""",
    "X1_enhanced": f"""{_TYPE}, q as (select *, {_Q} as q from typed), k as (select * from q where not (width < 200 or height < 200 or q < 0.4)),
        u as (select *, sub::double as s, tax::double as tx, total::double as tt from (select *, row_number() over (partition by {_FP} order by document_id) as r from k) where r = 1),
        e as (select document_id, doc_type, q, ocr_confidence, iso, tt as total, 0.8::double as ex, 'receipt' as fact, 'Trader Joes' as merchant, null as description, tt as amount,
            case when document_id % 7 = 0 then 'tip_detected' end as reason, '{{"merchant":"Trader Joes","amount":' || tt || ',"date":"' || iso || '"}}' as value from u where doc_type = 'receipt'
          union all select document_id, doc_type, q, ocr_confidence, iso, tt, 0.88, 'invoice', 'Acme Supplies Ltd', null, tt, null, '{{"merchant":"Acme Supplies Ltd","amount":' || tt || ',"date":"' || iso || '"}}' from u where doc_type = 'invoice'
          union all select document_id, doc_type, q, ocr_confidence, iso, null, 0.76, 'statement_transaction', 'GROCERY STORE', 'GROCERY STORE #' || store, tx, null, '{{"desc":"GROCERY STORE #' || store || '","amount":' || tx || '}}' from u where doc_type = 'statement'
          union all select document_id, doc_type, q, ocr_confidence, iso, null, 0.76, 'statement_transaction', 'DIRECT DEPOSIT', 'DIRECT DEPOSIT', s, null, '{{"desc":"DIRECT DEPOSIT","amount":' || s || '}}' from u where doc_type = 'statement'),
        z as (select *, case when ocr_confidence > 1 then ocr_confidence / 100 else ocr_confidence end as ocr, case when doc_type <> 'statement' and iso > '{TODAY}' then 0.7 else 1.0 end::double as con from e)
        select document_id, doc_type, merchant, description, iso as date, amount, 1.0::double as completeness, con as consistency, {_half_even('q * 0.3 + ocr * 0.3 + 1.0 * 0.2 + con * 0.2')} as trust_score,
          case when q * 0.3 + ocr * 0.3 + 1.0 * 0.2 + con * 0.2 >= 0.75 then 'verified' when q * 0.3 + ocr * 0.3 + 1.0 * 0.2 + con * 0.2 >= 0.5 then 'low_confidence' else 'manual_review' end as status, reason, fact, value,
          {_half_even('ocr * ex * q')} as evidence from z""",
    "M2_explanation": f"{_R} select document_id, case when document_id % 7 = 0 then 'Tip may cause amount mismatch with bank transaction (tolerance: 20%)' else 'Exact match expected' end as explanation from x",
}
