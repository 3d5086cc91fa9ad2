"""Files in and out, uploads, the generator, and streams against their batch forms."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.operators import documents as o
from ledgerloom.plans import source_queries
from ledgerloom.sources import files as f
from ledgerloom.streaming import live


def test_csv_and_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("t1", dt.date(2026, 1, 1), -1.5, "A, \"B\"", None, "x")], f.RAW_SCHEMA)
    f.write_csv(df, str(tmp_path / "c"))
    assert f.read_csv(spark, str(tmp_path / "c")).collect() == df.collect()
    f.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    (tmp_path / "goals.json").write_text('{"user_goals": {"dining_budget": {"limit": 400, "period": "monthly"}, "savings_rate": {"target": 0.2}}}')
    assert sorted(tuple(r) for r in f.read_goals(spark, str(tmp_path / "goals.json")).collect()) == [("dining_budget", 400.0, None), ("savings_rate", None, 0.2)]


def test_upload(spark):
    df = spark.createDataFrame([("01/02/2026", "5.00", None, "Shop"), ("bad", None, "$1,000.00", None)], ["Posting Date", "Debit", "Credit ", "Narration"])
    got = sorted(((str(r.date), r.amount, r.merchant_raw, r.category) for r in f.normalize_upload(df).collect()), key=str)
    assert got == sorted([("2026-01-02", -5.0, "Shop", "uncategorized"), ("None", 1000.0, None, "uncategorized")], key=str)
    ids = [r.transaction_id for r in f.normalize_upload(df.repartition(3)).orderBy("transaction_id").collect()]
    assert ids == ["txn_0001", "txn_0002"]


def test_documents_folder(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"x")
    got = {r.extension: r.error for r in f.read_documents(spark, str(tmp_path)).select("extension", "error").collect()}
    assert got["png"] is None and got["txt"].startswith("unsupported")


def test_generator_plants_patterns(spark):
    df = f.generate_transactions(spark)
    tags = {r.pattern_tag for r in df.select("pattern_tag").distinct().collect()}
    assert tags == {"anomaly", "dining_spike", "grocery_drift", "savings_drop", "baseline"}
    assert df.where("category = 'income' and month(date) = 5").count() == 1
    assert df.exceptAll(f.generate_transactions(spark)).count() == 0


def test_generator_adds_discretionary_rows_in_may(spark):
    df = f.generate_transactions(spark)
    n = {(r.category, r.m): r["count"] for r in df.groupBy("category", F.month("date").alias("m")).count().collect()}
    for kind in ("dining", "shopping"):
        assert n[kind, 5] == int(1.5 * n[kind, 4])
    assert all(n[kind, 5] == n[kind, 4] for kind in ("groceries", "transportation", "utilities"))
    assert df.select("transaction_id").distinct().count() == df.count()


def test_generated_documents_give_their_truth(spark):
    docs = f.generate_documents(spark, 20)
    assert docs.exceptAll(f.generate_documents(spark, 20)).count() == 0
    truth = {r.document_id: r for r in docs.collect()}
    assert {r.degradation for r in truth.values()} == set(f.DEGRADATIONS)
    for kind, facts, name, amount, day in (("receipt", o.receipt_facts, "merchant", "total_amount", "date"), ("invoice", o.invoice_facts, "vendor", "total_due", "invoice_date"), ("statement", o.statement_facts, "account_holder", "ending_balance", None)):
        rows = facts(docs.where(F.col("doc_type") == kind).select("document_id", "raw_text")).collect()
        assert len(rows) == 20
        for r in rows:
            t = truth[r.document_id]
            assert r[name].upper() == t.merchant and abs(r[amount] - t.amount) < 0.005 and (day is None or r[day] == str(t.date))
            assert kind != "statement" or {x.date for x in r.transactions} == {str(t.date)}


def run(query, name, spark, mode):
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = run(live.spending(stream), "spending_out", spark, "complete")
    want = live.spending(events)
    assert sorted(got.select("start", "event_type", "n").collect()) == sorted(want.select("start", "event_type", "n").collect())
    docs = spark.createDataFrame([(1, "Shop\n$1.00", dt.datetime(2026, 1, 1)), (2, "Shop\n$1.00", dt.datetime(2026, 1, 2)), (3, "Other", dt.datetime(2026, 1, 3))], "k int, x string, ts timestamp")
    docs.write.parquet(str(tmp_path / "docs"))
    first = run(live.first_documents(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs")), "x", "ts"), "docs_out", spark, "append")
    assert first.count() == 2
    assert live.sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_a_folder_of_part_files_is_one_table(spark, tmp_path):
    df = spark.range(10)
    df.coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    df.repartition(3).write.parquet(str(tmp_path / "two.parquet"))
    df.toPandas().to_parquet(tmp_path / "three.parquet")
    df.toPandas().to_parquet(tmp_path / "other-1.parquet")
    got = sorted(tuple(x) for x in source_queries.QUERIES["S7_read_documents"](spark, str(tmp_path)).collect())
    assert got == [(f"{n}.parquet", "parquet", "unsupported format: parquet") for n in ("one", "three", "two")]
