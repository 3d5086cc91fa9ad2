"""Operator 6 against its SQL, a brute-force count, and on odd rows."""

import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from ledgerloom.llm.adaptive_rules import ORACLE_SQL, RULES, adaptive_rules, bucket, upper_edge

DIR = "/root/testdata/sf0.01"
BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def test_counts_by_brute_force_and_verdicts_by_sql(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = {r.doc_id: tuple(r) for r in adaptive_rules(docs).select(BASE).collect()}
    for r in docs.collect():
        assert got[r.doc_id][1:7] == brute(r.text)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DIR}/documents.parquet'")
    assert sorted(got.values()) == sorted(con.execute(f"select {', '.join(BASE)} from ({ORACLE_SQL})").fetchall())


def test_clean_stay_and_junk_goes(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    rows = adaptive_rules(docs).join(labels, "doc_id").where("n_words >= 20").collect()
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.05


FENCES = [f"fence_{x}" for x in RULES]


def _fences(df, **how):
    return {(r.lang, r.source): tuple(r[x] for x in FENCES) for r in adaptive_rules(df, **how).join(df.select("doc_id", "lang", "source"), "doc_id").select("lang", "source", *FENCES).distinct().collect()}


def test_fences_are_each_groups_own(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    before = _fences(docs)
    for k in range(len(RULES)):
        assert len({f[k] for f in before.values()}) > 10
    lang, source = "en", "src3"
    mine = (F.col("lang") == lang) & (F.col("source") == source)
    louder = docs.withColumn("text", F.when(mine, F.regexp_replace("text", r"(\w) (\w)", "$1, $2")).otherwise(F.col("text")))
    after = _fences(louder, spread=14, prior_rows=50)
    assert after[lang, source][0] > 1.5 * before[lang, source][0]
    moved = [(g, a[0] / before[g][0]) for g, a in after.items() if g != (lang, source) and a[0] != before[g][0]]
    assert all(0.9 < x < 1.12 for _, x in moved)  # through the prior rows of the language alone


def test_quantiles_shrink_without_a_jump(spark):
    """One text more or less moves a small group's fence by little, and a group of equal texts keeps its language's width."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    line = lambda: " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(60))
    rows = [(k, line(), "en", "big") for k in range(150)]
    few = [(1000 + k, line() + " " + ", ".join(words[:9]), "en", "small") for k in range(60)]
    same = [(2000 + k, few[0][1], "en", "copies") for k in range(80)]
    make = lambda n: spark.createDataFrame(rows + few[:n] + same, "doc_id long, text string, lang string, source string")
    got = {n: _fences(make(n)) for n in (48, 49, 50, 51)}
    for k in range(len(RULES)):
        sizes = [f["en", "small"][k] for f in got.values()]
        assert max(sizes) <= 1.15 * min(sizes)
    assert all(r.kept for r in adaptive_rules(make(50)).collect())


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, " \n\t\x0b", "en", "a"), (None, long, "en", "a"), (4, f"{long}\n{long}", "en", "a"), (4, f"{long}\n{long}", "en", "a"), (5, "é " * 20_000, "fr", "b"), (6, "a b c d e f g h a b c d e f g h", "en", "a"), (7, "0b x cab b0 x\\x0c", "en", "a"), (8, "\u00a0 x\u2003y", "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as n_words", "'x' as h")
    got = sorted((tuple(r) for r in adaptive_rules(df).select(BASE[:7]).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t, _, _ in rows), key=str)
    assert adaptive_rules(df.limit(0)).count() == 0


def test_sketch_buckets_bound_their_values(spark):
    df = spark.range(0, 70_000, 7).withColumn("b", bucket(F.col("id"))).withColumn("edge", upper_edge(F.col("b")))
    assert df.where("edge < id or edge > id + id / 32 + 1").count() == 0
    assert df.where("id < 64 and edge <> id").count() == 0
