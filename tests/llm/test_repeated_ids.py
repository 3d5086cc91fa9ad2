"""Rows that share an id but differ in text lose no text."""

import corpus_pipeline as pipeline


def test_near_dedup_of_repeated_ids(spark):
    first, own, other = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [(1, first), (5, first), (5, own), (5, own), (6, other), (7, own + " more"), (5, None), (None, first), (8, "")]
    got = [tuple(r) for r in pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert sorted(got, key=str) == sorted([(1, first), (5, own), (6, other), (5, None), (None, first), (8, "")], key=str)
