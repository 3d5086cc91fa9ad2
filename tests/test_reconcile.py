"""Tiers, assignment and mismatches on the golden cases, and assignment against a sequential pass."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import reconcile as r

TX = "ord long, id string, amount string, date string, merchant string, category string"
DOC = "ord long, id string, amount string, date string, merchant string, doc_type string, trust_score double"


def tx(spark, *rows):
    return spark.createDataFrame([(k, i, a, d, m, "other") for k, (i, a, d, m) in enumerate(rows)], TX)


def docs(spark, *rows):
    return spark.createDataFrame([(k, i, a, d, m, "receipt", t) for k, (i, a, d, m, t) in enumerate(rows)], DOC)


@pytest.fixture(scope="module")
def golden(spark):
    left = tx(spark, ("txn_001", "45.67", "2026-02-01", "SQ * COFFEE SHOP"), ("txn_002", "120.00", "2026-02-02", "Whole Foods"), ("txn_003", "55.00", "2026-02-03", "John's Coffee"), ("txn_004", "67.89", "2026-02-04", "AMZN MKTP"))
    right = docs(spark, ("doc_001", "$45.67", "2026-02-01", "Coffee Shop", 0.95), ("doc_002", "120.00", "02/02/2026", "Whole Foods Market", 0.90), ("doc_003", "50.00", "2026-02-03", "John's Coffee", 0.88), ("doc_004", "67.89", "2026-02-04", "Amazon Marketplace", 0.85))
    return left, right, r.assign(r.tiers(left, right)).cache()


def test_golden_case(golden):
    got = {x.t_id: (x.d_id, x.match_type, x.status, round(x.confidence, 3), x.reason, x.amount_discrepancy) for x in golden[2].collect()}
    assert got == {
        "txn_001": ("doc_001", "EXACT", "SUPPORTED", 0.995, None, None), "txn_002": ("doc_002", "FUZZY", "SUPPORTED", 0.99, None, None),
        "txn_003": ("doc_003", "FUZZY", "PARTIAL", 0.898, "tip_adjustment", 5.0), "txn_004": ("doc_004", "SEMANTIC", "SUPPORTED", 0.985, "abbreviation", None)}


@pytest.mark.parametrize(("amounts", "days", "names", "trust", "tier", "confidence"), [
    (("45.67", "45.67"), 0, ("SQ * COFFEE SHOP", "Coffee Shop"), 0.95, "EXACT", 0.995), (("45.67", "49.67"), 0, ("Coffee Shop", "Coffee Shop"), 0.90, "FUZZY", 0.900),
    (("45.67", "45.67"), 2, ("Coffee Shop", "Coffee Shop"), 0.85, "FUZZY", 0.945), (("100.00", "100.80"), 0, ("Coffee Shop", "Coffee Shop"), 0.90, "FUZZY", 0.9186), (("50", "55"), 1, ("Coffee Shop", "Coffee Shop Downtown"), 0.90, "FUZZY", 0.880),
    (("45.67", "45.67"), 0, ("AMZN MKTP", "Amazon Marketplace"), 0.9, "SEMANTIC", 0.99)])
def test_tier_cases(spark, amounts, days, names, trust, tier, confidence):
    left, right = tx(spark, ("t", amounts[0], "2026-03-10", names[0])), docs(spark, ("d", amounts[1], f"2026-03-{10 + days}", names[1], trust))
    m = r.cascade(r.tiers(left, right)).first()
    assert m.match_type == tier and m.confidence == pytest.approx(confidence, abs=1e-4)


@pytest.mark.parametrize(("a", "b", "days", "names"), [("50.00", "45.00", 0, ("Alpha", "Zulu Kilo")), ("50.00", "60.00", 0, ("Same", "Same")), ("50.00", "50.00", 6, ("Same", "Same")), ("50.00", None, 0, ("Same", "Same")), (None, "50", 0, ("Same", "Same")), ("x", "50", 0, ("Same", "Same"))])
def test_rejects(spark, a, b, days, names):
    left, right = tx(spark, ("t", a, "2026-03-10", names[0])), docs(spark, ("d", b, f"2026-03-{10 + days}", names[1], 0.9))
    assert r.cascade(r.tiers(left, right)).count() == 0


def test_candidates_are_the_predicates(spark):
    rng = random.Random(8)
    amounts = [rng.choice([rng.uniform(0, 130), rng.uniform(90, 110), rng.uniform(100, 5000)]) for _ in range(160)]
    rows = [(f"{a:.2f}", rng.randint(1, 28)) for a in amounts]
    left = tx(spark, *((f"t{k}", a, f"2026-01-{d:02}", "m") for k, (a, d) in enumerate(rows[:80])))
    right = docs(spark, *((f"d{k}", a, f"2026-01-{d:02}", "m", 1.0) for k, (a, d) in enumerate(rows[80:])))
    got = {(x.t_id, x.d_id) for x in r.candidates(left, right).collect()}
    close = lambda a, b: abs(a - b) <= 5 + 1e-9 or abs(a - b) <= 0.05 * max(a, b)
    want = {(f"t{i}", f"d{j}") for i, (a, d) in enumerate(rows[:80]) for j, (b, e) in enumerate(rows[80:]) if abs(d - e) <= 5 and close(float(a), float(b))}
    assert got == want


def sequential(edges):
    taken, out = set(), {}
    for t in sorted({e[0] for e in edges}):
        best = min(((-c, d) for x, d, c in edges if x == t and d not in taken), default=None)
        if best:
            out[t] = best[1]
            taken.add(best[1])
    return out


def test_assignment_is_the_sequential_one(spark):
    rng = random.Random(2)
    edges = sorted({(t, d): rng.choice([0.6, 0.7, 0.8, 0.9]) for t in range(25) for d in rng.sample(range(20), 6)}.items())
    struct = "struct<confidence:double,match_type:string>"
    df = spark.createDataFrame([(f"t{t}", t, f"d{d}", d, 0, (c, "EXACT"), None, None) for (t, d), c in edges], f"t_id string, t_ord int, d_id string, d_ord int, days int, exact {struct}, fuzzy {struct}, semantic {struct}")
    got = {x.t_ord: x.d_ord for x in r.assign(df).collect()}
    assert got == sequential([(t, d, c) for (t, d), c in edges])


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_values_meet_as_classes(spark, seed):
    """Many rows of few amounts, days, names and trusts: the sequential pass over all pairs of rows, from pairs of classes alone."""
    rng = random.Random(seed)
    names = ["Coffee Shop", "Coffee Shop Downtown", "Alpha"]
    day = lambda: f"2026-03-{rng.choice([10, 11, 12, 14]):02}"
    left = tx(spark, *((f"t{k}", rng.choice(["50.00", "50.20", "54.00"]), day(), rng.choice(names)) for k in range(260)))
    right = docs(spark, *((f"d{k}", rng.choice(["50.00", "52.00"]), day(), rng.choice(names), rng.choice([0.7, 0.9])) for k in range(200)))
    scored = r.tiers(left, right)
    assert scored.tx.members.count() == 260 and scored.tx.classes.count() <= 36 and scored.pairs.count() <= 36 * 48
    rows = r._expanded(scored, r.edges(scored.pairs, 0.6))
    pairs = [(x.t_ord, x.d_ord, x.confidence) for x in rows.collect()]
    assert len(pairs) > 5000
    got = {x.t_ord: x for x in r.assign(scored).collect()}
    want = sequential(pairs)
    assert {t: x.d_ord for t, x in got.items()} == want and len(want) > 100
    sure = {(t, d): c for t, d, c in pairs}
    assert all(x.confidence == sure[t, x.d_ord] and x.t_id == f"t{t}" and x.d_id == f"d{x.d_ord}" for t, x in got.items())
    best = {x.t_ord: (x.d_ord, x.d_id) for x in r.best_match(scored).collect()}
    every = [(x.t_ord, x.d_ord, x.confidence) for x in r._expanded(scored, r.edges(scored.pairs)).collect()]
    first = {}
    for t, d, c in every:
        first[t] = min(first.get(t, (0, 0)), (-c, d))
    assert best == {t: (d, f"d{d}") for t, (_, d) in first.items()}


def test_one_class_on_either_side(spark):
    """All rows alike: a round or two deals them out, each transaction the document of its rank."""
    left = tx(spark, *((f"t{k}", "9.99", "2026-03-10", "Music") for k in range(300)))
    right = docs(spark, *((f"d{k}", "9.99", "2026-03-10", "Music", 0.9) for k in range(250)))
    scored = r.tiers(left, right)
    assert scored.pairs.count() == 1
    assert {x.t_ord: x.d_ord for x in r.assign(scored).collect()} == {k: k for k in range(250)}


def test_names_are_compared_once(spark, monkeypatch):
    """300 pairs of 3 by 2 distinct names, compared in one Python step over the distinct pairs that a gate admits."""
    left = tx(spark, *((f"t{k}", "50.00", "2026-03-10", ["Alpha Shop", "Beta Cafe", "Gamma"][k % 3]) for k in range(30)))
    right = docs(spark, *((f"d{k}", "50.00", "2026-03-10", ["Alpha Shop", "Beta Cafe"][k % 2], 0.9) for k in range(10)))
    seen = []
    monkeypatch.setattr(r, "materialize", lambda df, tag, real=r.materialize: seen.append((tag, df)) or real(df, tag))
    assert r.best_match(r.tiers(left, right)).count() == 20
    scores = [df for tag, df in seen if tag == "name-scores"]
    assert len(scores) == 1 and scores[0].count() == 6
    plans = [df._jdf.queryExecution().executedPlan().toString() for _, df in seen]
    assert sum("ArrowEvalPython" in p for p in plans) == 1


def test_mismatches(spark, golden):
    left = spark.createDataFrame([(1, "txn_001", "1", "2026-01-01", "x", "y"), (2, "txn_n", "9.99", "2026-01-01", "NETFLIX", "subscriptions"), (3, "txn_i", "100", "2026-01-01", "ACME", "income"), (4, "txn_c", "1", "2026-01-01", "CORNER", None)], TX)
    u = {x.id: (x.reason, x.label) for x in r.unsupported(left, golden[2]).collect()}
    assert u == {"txn_n": ("digital_purchase_no_receipt", "Digital subscription"), "txn_i": ("income_deposit", "Direct deposit"), "txn_c": ("no_document_found", "Card transaction")}
    right = spark.createDataFrame([(1, "doc_a", None, "2026-01-01", None, "receipt", 0.3), (2, "doc_b", "0.0", "2026-01-01", "Shop", "receipt", 0.6), (3, "doc_c", "5", "2026-01-01", "Shop", "invoice", 0.7)], DOC)
    v = r.unreconciled(right, golden[2])
    assert {x.id: (x.reason, x.label) for x in v.collect()} == {"doc_a": ("low_trust_document", "Unverified document"), "doc_b": ("no_transaction_found", "Possible cash purchase"), "doc_c": ("unpaid_invoice", "Unpaid invoice")}
    notes = {x.story_note for x in r.markers(r.unsupported(left, golden[2]), v).collect()}
    assert "Receipt from Shop ($0.00) — no matching bank transaction" in notes and "Receipt from unknown — no matching bank transaction" in notes and "$9.99 at NETFLIX — no receipt found" in notes


def test_parsing(spark):
    df = spark.createDataFrame([("$1,234.50", "2026-03-15T10:30:00"), ("EUR 5", "3/15/2026"), ("x", "25/12/2026"), (None, "never")], "a string, d string")
    got = [(None if x[0] is None else float(x[0]), str(x[1].date()) if x[1] else None) for x in df.select(r.parse_amount(F.col("a")), r.parse_date(F.col("d"))).collect()]
    assert got == [(1234.5, "2026-03-15"), (5.0, "2026-03-15"), (None, "2026-12-25"), (None, None)]


def test_pairs_are_not_written(spark, monkeypatch):
    """3,600 pairs of 60 classes a side: no table is larger than a side; counts by class and listed pairs are those of the cascade."""
    left = tx(spark, *((f"t{k}", f"{50 + k / 100:.2f}", "2026-03-10", "Alpha Shop") for k in range(60)))
    right = docs(spark, *((f"d{k}", f"{50 + k / 100:.2f}", "2026-03-10", "Alpha Shop", 0.9) for k in range(60)))
    seen = []
    monkeypatch.setattr(r, "materialize", lambda df, tag, real=r.materialize: seen.append(real(df, tag)) or seen[-1])
    scored = r.tiers(left, right)
    assert {x.t_id: x.d_id for x in r.best_match(scored).collect()} == {f"t{k}": f"d{max(k - 1, 0)}" for k in range(60)}  # a cent is exact, and the earlier document counts
    assert max(df.count() for df in seen) == 60
    names = ("exact", "fuzzy", "semantic")
    pairs = {(x.t_id, x.d_id, x.match_type, x.confidence) for x in r.cascade(scored).collect()}
    assert len(pairs) == 3600 and pairs == {(x.t_id, x.d_id, x.match_type, x.confidence) for x in r.listed_matches(r.listed_tiers(left, right), *names).collect()}
    assert r.class_matches(r.tiers(left, right.drop("trust_score")), *names).agg(F.sum("n")).first()[0] == 3600


def test_lists_go_on_in_parts(spark):
    """Fourteen transactions that all want the same documents first: the last one gets what no first part of a list has."""
    left = tx(spark, *((f"t{k}", f"{50 + k / 100:.2f}", "2026-03-10", "Alpha Shop") for k in range(14)))
    right = docs(spark, *((f"d{k}", "50.00", "2026-03-10", "Alpha Shop", 1.0 - k / 14) for k in range(14)))
    scored = r.tiers(left, right)
    want = sequential([(x.t_ord, x.d_ord, x.confidence) for x in r._expanded(scored, r.edges(scored.pairs, 0.6)).collect()])
    assert len(want) == 14 and {x.t_ord: x.d_ord for x in r.assign(scored).collect()} == want


def test_few_names_need_no_cells(spark, monkeypatch):
    """Two names on many days and amounts: all pairs of names are compared without a meeting of cells, and matches are the same with one."""
    left = tx(spark, *((f"t{k}", f"{50 + k % 7 / 10:.2f}", f"2026-03-{10 + k % 5}", ["Alpha Shop", "Beta Cafe"][k % 2]) for k in range(40)))
    right = docs(spark, *((f"d{k}", f"{50 + k % 5 / 10:.2f}", f"2026-03-{10 + k % 7}", ["Alpha Shop", "Beta Café"][k % 2], 0.9) for k in range(30)))
    best = lambda: sorted(map(tuple, r.best_match(r.tiers(left, right)).collect()))
    few = r.FEW_NAME_PAIRS
    monkeypatch.setattr(r, "FEW_NAME_PAIRS", 0)
    by_cells = best()
    monkeypatch.setattr(r, "FEW_NAME_PAIRS", few)
    monkeypatch.setattr(r, "_met_names", lambda *_: pytest.fail("cells met"))
    assert best() == by_cells and len(by_cells) == 40


def test_mismatches_write_no_more_than_they_read(spark, monkeypatch):
    from ledgerloom.plans import reconcile_queries as q

    left, right = tx(spark, *((f"t{k}", "9.99", "2026-03-10", "Music") for k in range(20))), docs(spark, ("d0", "9.99", "2026-03-10", "Music", 0.9), ("d1", "70.00", "2026-03-10", "Music", 0.9))
    seen = []
    monkeypatch.setattr(q, "recon_inputs", lambda s, d: (left, right))
    monkeypatch.setattr(q, "materialize", lambda df, tag, real=q.materialize: seen.append(real(df, tag)) or seen[-1])
    lost, alone, _ = q._open(spark, "")
    assert [df.columns for df in seen] == [["t_id", "d_id", "confidence"]] and seen[0].count() == 20
    assert lost.count() == 0 and [x.id for x in alone.collect()] == ["d1"]
    assert "HashAggregate(keys=[id" in alone._jdf.queryExecution().executedPlan().toString()  # a document that many transactions take is shuffled once


def test_rows_are_shuffled_by_cells_not_once_for_each_bucket(spark):
    """F4-F6, F9-F15: what a row reaches is spelled out behind the shuffle, also where it lies in the next cell."""
    rng = random.Random(4)
    rows = [(rng.choice([rng.uniform(0, 900), rng.uniform(0, 9)]), rng.randint(-200, 200)) for _ in range(300)]
    sides = [spark.createDataFrame([(k, 0, f"{a:.2f}", d, 0.5) for k, (a, d) in enumerate(part)], "id long, name long, a string, d int, trust double")
        .select("id", "name", F.col("a").cast("decimal(18,4)").alias("amount"), F.date_add(F.lit("1970-01-01").cast("date"), F.col("d")).alias("day"), "trust") for part in (rows[:150], rows[150:])]
    scores = spark.createDataFrame([(0, 0, 1.0)], "t_name long, d_name long, s1 double")
    for name, reach in r.REACH.items():
        pairs = r.close_pairs(*sides, reach, scores)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
        assert dealt and not [x for x in dealt if "db#" in x or "ab#" in x], name
        got = sorted((x.t_id, x.d_id) for x in pairs.collect())
        cents = lambda x: int(f"{x:.2f}".replace(".", ""))
        near = lambda a, b: abs(a - b) <= 100 * reach.amount or abs(a - b) <= reach.share * max(a, b)
        assert got == sorted((i, j) for i, (a, d) in enumerate(rows[:150]) for j, (b, e) in enumerate(rows[150:]) if abs(d - e) <= reach.days and near(cents(a), cents(b))), name


def test_best_match_shuffles_no_pairs(spark):
    """what is found for a class of transactions stays where its pairs are formed, and no table but the result's inputs keeps what was shuffled."""
    left = tx(spark, *((f"t{k}", f"{50 + k % 9}.00", f"2026-03-{10 + k % 5}", "Alpha Shop") for k in range(40)))
    right = docs(spark, *((f"d{k}", f"{50 + k % 7}.00", f"2026-03-{10 + k % 6}", "Alpha Shop", k % 3 / 10 + 0.5) for k in range(30)))
    scored = r.tiers(left, right)
    best = r.best_match(scored)
    plan = best._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(dealt) == 3 and all("hashpartitioning(dc#" in x and "_class#" not in x for x in dealt)
    first = {}
    for x in r._expanded(scored, r.edges(scored.pairs)).collect():
        first[x.t_id] = min(first.get(x.t_id, (0, 0, "")), (-x.confidence, x.d_ord, x.d_id))
    assert {x.t_id: (-x.confidence, x.d_ord, x.d_id) for x in best.collect()} == first and len(first) == 40


def test_unreconciled_lists_no_transactions(spark, monkeypatch):
    """documents are told by what classes take; one row a document is written and nothing else is left."""
    from ledgerloom.functions.storage import written
    from ledgerloom.plans import reconcile_queries as q

    left, right = tx(spark, *((f"t{k}", "9.99", "2026-03-10", "Music") for k in range(20))), docs(spark, ("d0", "9.99", "2026-03-10", "Music", 0.9), ("d1", "70.00", "2026-03-10", "Music", 0.9))
    before, seen = written(spark), []
    monkeypatch.setattr(q, "recon_inputs", lambda s, d: (left, right))
    monkeypatch.setattr(q, "materialize", lambda df, tag, real=q.materialize: seen.append(real(df, tag)) or seen[-1])
    alone = q.QUERIES["J18_J20_unreconciled"](spark, "")
    assert len(written(spark) - before) == 1
    assert [df.columns for df in seen] == [["d_id", "confidence"]] and seen[0].count() == 1
    assert [x.id for x in alone.collect()] == ["d1"]


def test_lists_of_a_tier_meet_only_names_alike_for_it(spark, monkeypatch):
    """names that only another tier takes for the same are not dealt out."""
    from ledgerloom.plans import reconcile_queries as q

    left, right = tx(spark, ("t0", "9.99", "2026-03-10", "AMZN MKTP"), ("t1", "9.99", "2026-03-10", "Music")), docs(spark, ("d0", "9.99", "2026-03-10", "Amazon Marketplace", 0.9), ("d1", "9.99", "2026-03-10", "Music", 0.9))
    seen = []
    monkeypatch.setattr(q, "recon_inputs", lambda s, d: (left, right))
    monkeypatch.setattr(r, "close_pairs", lambda t, d, reach, scores, real=r.close_pairs: seen.append(scores) or real(t, d, reach, scores))
    got = [(x.t_id, x.d_id) for x in q.QUERIES["J8_fuzzy"](spark, "").collect()]
    assert got == [("t1", "d1")] and seen[0].count() == 1


@pytest.mark.parametrize(("name", "left_over"), [("J21_summary", 3), ("J22_markers", 2)])
def test_sides_of_mismatches_are_shuffled_one_after_the_other(spark, monkeypatch, name, left_over):
    """what of one side is a result is written before the other side is dealt out, and nothing else is left."""
    from ledgerloom.functions.storage import written
    from ledgerloom.plans import reconcile_queries as q

    left, right = tx(spark, ("t0", "9.99", "2026-03-10", "Music"), ("t1", "800.00", "2026-03-10", "Gamma")), docs(spark, ("d0", "9.99", "2026-03-10", "Music", 0.9), ("d1", "70.00", "2026-03-10", "Music", 0.9))
    monkeypatch.setattr(q, "recon_inputs", lambda s, d: (left, right))
    before = written(spark)
    out = q.QUERIES[name](spark, "")
    assert len(written(spark) - before) == left_over
    rows = sorted(map(tuple, out.collect()), key=str)
    if name == "J21_summary":
        assert rows == [("matches", "supported", 1), ("unreconciled", "likely_cash_purchase", 1), ("unsupported", "no_document_found", 1)]
    else:
        assert [x.story_note for x in out.orderBy("type").collect()] == ["Receipt from Music ($70.00) — no matching bank transaction", "$800.00 at Gamma — no receipt found"]


def test_best_documents_are_sought_near_first(spark, monkeypatch):
    """F1, F2, F4-F10: where documents are dense, few of the pairs within reach are formed, and every transaction has the best one of all, ties by order included."""
    rng = random.Random(6)
    names = ["Alpha Shop", "Alpha Shop 12", "Beta Cafe"]
    amount = lambda: f"{rng.choice([rng.uniform(0, 3), rng.uniform(900, 1100), rng.choice([1000.0, 1000.01, 1004.0])]):.2f}"
    left = tx(spark, *((f"t{k}", amount(), f"2026-03-{rng.randint(10, 19)}", rng.choice(names)) for k in range(400)), ("far", "5000.00", "2026-03-10", "Alpha Shop"))
    right = docs(spark, *((f"d{k}", amount(), f"2026-03-{rng.randint(10, 19)}", rng.choice(names), rng.choice([0.4, 0.9, 0.95, 0.99, 0.99])) for k in range(1500)), ("off", "5200.00", "2026-03-14", "Alpha Shop 12", 0.4))
    formed = []
    monkeypatch.setattr(r, "close_pairs", lambda *x, real=r.close_pairs: formed.append(real(*x)) or formed[-1])
    best = lambda: sorted(map(tuple, r.best_match(r.tiers(left, right)).collect()))
    whole = best()
    pairs = formed[0].count()
    formed.clear()
    monkeypatch.setattr(r, "FEW_CLASSES", 0)
    counts, real = [], r.materialize

    def counted(df, tag):
        counts.append((tag, (out := real(df, tag)).count()))
        return out

    monkeypatch.setattr(r, "materialize", counted)
    assert best() == whole and len(whole) > 390 and ("far", "off") in {(x[0], x[2]) for x in whole}
    found = [n for tag, n in counts if tag == "best"]
    assert len(found) == 4 and sum(found) == next(n for tag, n in counts if tag == "won") and found[0] + found[1] > 200
    assert formed[0].count() < pairs / 20


def test_counts_of_pairs_are_made_where_pairs_meet(spark, monkeypatch):
    """counts by days and reason are those of the listed pairs; no tier's struct is made for a pair."""
    rng = random.Random(9)
    names = ["Alpha Shop", "Alpha Shop 12", "AMZN MKTP", "Amazon Marketplace", "amazon market"]
    amount = lambda: f"{rng.choice([0.0, 0.01, 50.0, 52.0, 55.0, 200.0, 201.5, 206.0, 1000.0, 1009.0, 1040.0]):.2f}"
    left = tx(spark, *((f"t{k}", amount(), f"2026-03-{rng.randint(10, 18)}", rng.choice(names)) for k in range(120)))
    right = docs(spark, *((f"d{k}", amount(), f"2026-03-{rng.randint(10, 18)}", rng.choice(names), 0.9) for k in range(120)))
    tiers = ("exact", "fuzzy", "semantic")
    listed = r.listed_matches(r.listed_tiers(left, right), *tiers).groupBy("days", "reason").count()
    want = sorted(map(tuple, listed.collect()), key=str)
    monkeypatch.setattr(r, "_match", lambda *_: pytest.fail("a struct for each pair"))
    got = r.class_matches(r.tiers(left, right.drop("trust_score")), *tiers).groupBy("days", "reason").agg(F.sum("n"))
    assert sorted(map(tuple, got.collect()), key=str) == want and len({x[1] for x in want}) >= 5


def test_lists_are_made_near_first(spark, monkeypatch):
    """where documents are dense, lists come from documents near by; assignment is the sequential one, also for who must look far."""
    rng = random.Random(12)
    row = lambda: (f"{1000 + rng.choice([0, 0, 0.01, 3, 8, 30, 45]):.2f}", f"2026-03-{rng.randint(10, 15)}", rng.choice(["Alpha Shop", "Alpha Shop 12"]))
    left = tx(spark, *((f"t{k}", *row()) for k in range(60)))
    right = docs(spark, *((f"d{k}", *row(), rng.choice([0.5, 0.9, 0.98, 0.99])) for k in range(130)))
    scored = r.tiers(left, right)
    want = sequential([(x.t_ord, x.d_ord, x.confidence) for x in r._expanded(scored, r.edges(scored.pairs, 0.6)).collect()])
    monkeypatch.setattr(r, "FEW_CLASSES", 0)
    counts, real = [], r.materialize

    def counted(df, tag):
        counts.append((tag, (out := real(df, tag)).count()))
        return out

    monkeypatch.setattr(r, "materialize", counted)
    assert {x.t_ord: x.d_ord for x in r.assign(scored).collect()} == want and len(want) == 60
    lists = [n for tag, n in counts if tag == "cuts"]
    assert len(lists) >= 4 and sum(lists[:3]) > 0
