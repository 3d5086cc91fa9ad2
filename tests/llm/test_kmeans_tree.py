"""Operator 5 against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.kmeans_tree import Tree, search
from ledgerloom.llm.queries import op5_nearest_neighbours


def brute(ids, x, queries, k):
    out = {}
    for i in queries:
        q = x[ids.index(i)]
        d = np.sqrt(((x - q) ** 2).sum(1))
        out[i] = [(ids[j], d[j]) for j in sorted(range(len(ids)), key=lambda j: (d[j], ids[j])) if ids[j] != i][:k]
    return out


@pytest.mark.parametrize("registered", [False, True])
def test_recall_and_exact_scores(spark, registered):
    """Small leaves, and the registered query with its own parameters."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    got = {}
    found = op5_nearest_neighbours(spark, "/root/testdata/sf0.1") if registered else search(df, leaf_rows=64)
    for r in found.collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = brute(ids, x, [i for i in ids if i % 100 == 0], 10)
    assert set(got) == set(want)
    hits = 0
    for q, truth in want.items():
        assert sorted(got[q]) == list(range(1, 11))
        pairs = [got[q][k] for k in range(1, 11)]
        assert pairs == sorted(pairs, key=lambda p: (p[1], p[0]))
        for i, s in pairs:
            assert abs(s - np.sqrt(((x[ids.index(i)] - x[ids.index(q)]) ** 2).sum())) < 1e-12
        hits += len({i for i, _ in pairs} & {i for i, _ in truth})
    assert hits / (10 * len(want)) >= 0.95


def test_visiting_all_leaves_reaches_each_once():
    x = np.random.default_rng(0).normal(size=(500, 8))
    t = Tree.fit(x, 10)
    assert sorted(t.visit(x[3], t.leaves)) == list(range(t.leaves))
    assert t.visit(x[3], 1) == [t.assign(x[3:4])[0]]


def test_hot_vector_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(700)] + [(700 + i, rng.normal(size=3).tolist()) for i in range(700)]
    rows += [(2000, None), (2100, [0.0, 0.0, 0.0]), (2200, [1.0, None, 2.0]), (2300, [float("nan"), 1.0, 1.0]), (2400, [1.0]), (None, [1.0, 1.0, 1.0]), (100, [1.0, 2.0, 3.0]), (7, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"leaf": F.lit("x"), "score": F.lit(1)})
    got = {}
    for r in search(df, leaf_rows=50, recall=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1400, 100))
    assert [v for _, v, _ in sorted(got[0])] == list(range(1, 11))
    assert [v for _, v, _ in sorted(got[300])] == list(range(10)) and all(s == 0 for _, _, s in got[300])
    assert search(df.limit(0)).count() == 0
    few = {(r.query_id, r.rank, r.vec_id) for r in search(df.where("vec_id in (1300, 1301, 1302)")).collect()}
    assert {(q, k) for q, k, _ in few} == {(1300, 1), (1300, 2)}
