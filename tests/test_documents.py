"""Extraction, classification and trust on written-out documents."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import documents as o
from ledgerloom.operators import trust as t

RECEIPT = "TRADER JOE'S\n2026-02-07\n3x Greek Yogurt $14.97\nOrganic Bananas $21.94\nSUBTOTAL $36.91\nTAX 6.0% $2.21\nTOTAL $39.12\nDEBIT"
STATEMENT = "BANK OF TOWN MONTHLY STATEMENT\nJANE ROE\nStatement Period: 01/01/2026 to 01/31/2026\nBeginning Balance: $5,200.00\n01/05/2026 WHOLE FOODS 45.67 5,154.33\n01/09/2026 DIRECT DEPOSIT 2,500.00 7,654.33\n01/12/2026 SHELL OIL -48.50 7,605.83\nEnding Balance: $7,605.83"
INVOICE = "TECH SOLUTIONS LLC\nInvoice #: INV-2026-001234\nDue Date: 03/17/2026\nDate: 02/15/26\nBill To: Client Corp\nItem | Qty | Price | Amount\nConsulting | 10 | $250.00 | $2,500.00\nSubtotal: $2,500.00\nTax (8%): $200.00\nTotal Due: $2,700.00\nPayment Terms: Net 30"


def frame(spark, *texts):
    return spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "document_id int, raw_text string")


def test_receipt(spark):
    f = o.receipt_facts(frame(spark, RECEIPT)).first()
    assert (f.merchant, f.date, f.total_amount, f.subtotal, f.tax, f.tax_rate, f.payment_method, f.extraction_confidence) == ("Trader Joe's", "2026-02-07", 39.12, 36.91, 2.21, 6.0, "DEBIT", 0.8)
    assert [(i.quantity, i.name, i.price) for i in f["items"]] == [(3, "Greek Yogurt", 14.97), (1, "Organic Bananas", 21.94)]


@pytest.mark.parametrize(("text", "date"), [("on 2012-02-07", "2012-02-07"), ("x 3/4/99", "1999-03-04"), ("13/45/2020 then 2-3-21", "2021-02-03"), ("none", None)])
def test_receipt_dates(spark, text, date):
    assert frame(spark, text).select(o.receipt_date(F.col("raw_text"))).first()[0] == date


def test_compat_date_and_fallback_total(spark):
    assert frame(spark, "2012-02-07").select(o.receipt_date(F.col("raw_text"), iso_first=False)).first()[0] == "2007-12-02"
    assert frame(spark, "a $3.50\nb $1,200.00").select(o.receipt_total(F.col("raw_text"))).first()[0] == 1200.0


def test_item_cascade():
    """A form that gives a known or unlikely item leaves its line to the next form."""
    item = lambda q, n, p: {"quantity": q, "name": n, "price": p}
    assert o.items_of("2x Apple $1.00\nPear x3 $14.97\nFig 4 $2.00\nSUBTOTAL $3.00\n\nPlum $2.50") == [item(2, "Apple", 1.0), item(3, "Pear", 14.97), item(4, "Fig", 2.0), item(1, "Plum", 2.5)]
    assert o.items_of("Pear x3 $14.97\nPear 3 $14.97") == [item(3, "Pear", 14.97), item(1, "Pear 3", 14.97)]
    assert o.items_of("Desk $600.00") == []
    assert o.items_of(None) == []


def test_statement(spark):
    f = o.statement_facts(frame(spark, STATEMENT)).first()
    assert (f.account_holder, f.statement_period.start, f.statement_period.end, f.beginning_balance, f.ending_balance, f.extraction_confidence) == ("Jane Roe", "2026-01-01", "2026-01-31", 5200.0, 7605.83, 0.79)
    assert [(x.date, x.description, x.amount, x.transaction_type, x.balance) for x in f.transactions] == [
        ("2026-01-05", "WHOLE FOODS", 45.67, "debit", 5154.33), ("2026-01-09", "DIRECT DEPOSIT", 2500.0, "credit", 7654.33), ("2026-01-12", "SHELL OIL", 48.5, "debit", 7605.83)]
    n = frame(spark, "STORE #1234 145.67 1 234.56").select(o.statement_normalize(F.col("raw_text"))).first()[0]
    assert n == "STORE #1234 145.67 1234.56"


def test_invoice(spark):
    f = o.invoice_facts(frame(spark, INVOICE)).first()
    assert (f.invoice_number, f.vendor, f.client, f.invoice_date, f.due_date, f.subtotal, f.tax, f.tax_rate, f.total_due, f.payment_terms) == (
        "INV-2026-001234", "Tech Solutions Llc", "Client Corp", "2026-02-15", "2026-03-17", 2500.0, 200.0, 8.0, 2700.0, "Net 30")
    assert [(x.description, x.quantity, x.unit_price, x.amount) for x in f.line_items] == [("Consulting", 10, 250.0, 2500.0)]
    assert f.extraction_confidence == 0.88
    assert o.invoice_facts(frame(spark, "Auto Parts\nBill To: Me\n#INV-123456\nx")).first().client == "Me"


def test_types_and_routes(spark):
    df = frame(spark, RECEIPT, STATEMENT, INVOICE, "nothing here", "").withColumns({"w": F.lit(600), "h": F.lit(1000)})
    got = [tuple(x) for x in df.select(o.doc_type(F.col("raw_text"), F.col("w"), F.col("h")).alias("t")).select("t.type", "t.status").collect()]
    assert [x[0] for x in got[1:3]] == ["statement", "invoice"] and got[3] == got[4] == ("unknown", "low_confidence")


def test_empty_texts_give_empty_facts(spark):
    df = frame(spark, None, "")
    for facts in (o.receipt_facts, o.statement_facts, o.invoice_facts):
        rows = facts(df).collect()
        assert len(rows) == 2 and all(r.extraction_confidence in (0.0, None) for r in rows)


def test_process(spark):
    df = spark.createDataFrame([(1, "receipt", RECEIPT, 0.0), (2, "statement", STATEMENT, 0.0), (3, "invoice", INVOICE, 0.0), (4, "receipt", "no total", 0.0)], "document_id int, doc_type string, raw_text string, ocr_confidence double")
    got = sorted((r.document_id, r.merchant, r.amount, round(r.evidence, 4)) for r in o.process_documents(df).collect())
    assert (1, "Trader Joe's", 39.12, 0.6992) in got and len(got) == 5 and not any(x[0] == 4 for x in got)


def test_trust(spark):
    row = spark.range(1).select(t.trust_score(F.lit(0.89), F.lit(0.95), F.lit(1.0), F.lit(1.0)).alias("a"), t.trust_score(F.lit(89.0), F.lit(95.0), F.lit(1.0), F.lit(1.0)).alias("b")).first()
    assert row.a.trust_score == row.b.trust_score == 0.952 and row.a.status == "verified"
    d = F.lit("2026-01-01").cast("date")
    c = spark.range(1).select(t.consistency(d, F.lit(10.0), F.lit(9.0), F.lit(0.5), F.lit("2025-01-01").cast("date")), t.consistency(d, F.lit(-1.0), F.lit(None).cast("double"), F.lit(None).cast("double"), d)).first()
    assert [round(x, 4) for x in c] == [0.5, 0.7]


def test_partial_flags(spark):
    rows = [("dinner TIP 5", 1.0, 1.0, 2.0), ("paid in EUR", None, None, None), ("AVOCADOS", None, None, None), ("REFUND", 1.0, 1.0, 2.0), ("plain", 10.0, 1.0, 12.0), ("plain", 10.0, 1.0, 11.0)]
    df = spark.createDataFrame(rows, "x string, s double, t double, total double")
    got = [r[0] for r in df.select(t.partial_match_flag(F.col("x"), F.col("s"), F.col("t"), F.col("total")).alias("f")).select("f.reason").collect()]
    assert got == ["tip_detected", "currency_conversion", "currency_conversion", "refund", "internal_math_discrepancy", None]


def test_duplicates(spark):
    rows = [(1, "Shop A\n$1.00\n1/2/2026"), (2, "shop a\n $1.00 1/2/2026"), (3, "Shop B\n$1.00"), (4, ""), (5, None), (6, "Shop B\n$1.00 ")]
    got = {r.k: r.is_duplicate for r in t.duplicates(spark.createDataFrame(rows, "k int, x string"), "k", "x").collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: True, 6: True}


def test_zero_totals_and_missing_fields(spark):
    """A receipt's total of 0 counts as missing, an invoice's is wrong; rows without amount or date give no transaction."""
    lit = lambda *x: [F.lit(v).cast("double") for v in x]
    day = F.lit("2024-01-01").cast("date")
    got = spark.range(1).select(*(t.consistency(day, *lit(total, 5, 1), day, wrong).alias(f"c{k}") for k, (total, wrong) in enumerate([(0, False), (0, True), (-2, False), (6, True), (9, False)]))).first()
    assert [round(x, 6) for x in got] == [1.0, 0.7, 0.5, 1.0, 0.8]
    invoice = "ACME LTD\nInvoice #INV-1\nDate: 1/5/2024\nBill To:\nclient\nTotal Due: $0.00\nPayment Terms: Net 30"
    statement = "FIRST BANK STATEMENT\nJOHN DOE\nStatement Period: 1/1/2024 to 1/31/2024\n1/5/2024 COFFEE 3.00 97.00\n1/6/2024 DIRECT DEPOSIT 50.00 147.00"
    receipt = "CORNER SHOP\n1/5/2024\nTea $2.00\nTOTAL $2.00\nTIP"
    rows = [(1, "invoice", invoice), (2, "statement", statement), (3, "unknown", receipt), (4, "receipt", "nothing here"), (5, "receipt", receipt)]
    docs = spark.createDataFrame(rows, "document_id long, doc_type string, raw_text string").withColumns({"quality_score": F.lit(0.9), "ocr_confidence": F.lit(90.0)})
    out = sorted(o.enhanced(docs, F.lit("2025-01-01").cast("date")).collect(), key=lambda r: (r.document_id, r.amount))
    assert [(r.document_id, r.doc_type, r.amount) for r in out] == [(1, "invoice", 0.0), (2, "statement", 3.0), (2, "statement", 50.0), (3, "receipt", 2.0)]
    assert [round(r.consistency, 6) for r in out] == [0.7, 1.0, 1.0, 1.0]
    assert out[3].partial.reason == "tip_detected" and out[1].merchant == "COFFEE" and out[1].partial is None
    assert all(r.chain.status == r.status for r in out) and out[1].chain.field == "statement_transaction"


def test_items_are_found_once_where_they_are_exploded(spark):
    """the filter that comes with an explode does not run the function once more."""
    rows = spark.createDataFrame([(1, "2x Greek Yogurt $3.00\nBread $1.29\nTOTAL $4.29"), (2, None)], "k long, raw_text string").repartition(2)
    items = o.receipt_facts(rows).select("k", F.explode("items").alias("x"))
    plan = items._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [receipt_items") == 1
    assert sorted((r.k, r.x["name"], r.x["price"]) for r in items.collect()) == [(1, "Bread", 1.29), (1, "Greek Yogurt", 3.0)]


def test_a_types_words_are_looked_for_in_a_text_that_is_lowered_once(spark):
    """one lower-casing and one search for tables a document, not one for each word and each use."""
    rows = spark.createDataFrame([("Invoice | 1 | $2.00\nTotal 3 4",)], "t string").repartition(1)
    typed = rows.select(o.doc_type(F.col("t"), F.lit(800), F.lit(1000)).alias("x"))
    plan = typed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and plan.count("regexp_extract_all(") == 1
