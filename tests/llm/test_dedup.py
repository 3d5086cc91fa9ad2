"""Operators 1 and 7 against brute force on small tables."""

import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import minhash_dedup
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.line_dedup import remove_repeated_units
from ledgerloom.llm.minhash_dedup import intersections, near_duplicates

DOCS = "/root/testdata/sf0.01/documents.parquet"


def shingles(text, k):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    k = min(k, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute_components(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_set = {}
    for i, s in sorted(sets.items()):
        if s:
            by_set.setdefault(s, []).append(i)
    for group in by_set.values():
        for i in group:
            parent[find(i)] = min(find(i), find(group[0]))
    for (a, i), (b, j) in combinations([(s, g[0]) for s, g in by_set.items()], 2):
        small, large = sorted((len(a), len(b)))
        if 100 * small >= 80 * large and 100 * len(a & b) >= 80 * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_match_brute_force(spark, words):
    docs = spark.read.parquet(DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, shingle_words=words).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()], words)


def test_chains_hot_groups_and_residual_buckets(spark):
    base = [f"w{i}" for i in range(60)]
    rows = []
    for n in range(40):  # a chain: neighbours are linked, the ends are not
        rows.append((n, " ".join(base[n:] + [f"x{i}" for i in range(n)])))
    rows += [(100 + n, " ".join(base[:50] + [f"y{n}_{i}" for i in range(6)])) for n in range(300)]
    rows += [(1000 + n, "the same text of a hot group of copies") for n in range(500)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one"), (2004, "one"), (2005, "ONE"), (2006, "Éa éa"), (2007, "éa Éa")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2).collect()}
    assert got == brute_components(rows, 2)


@pytest.mark.parametrize("block", [64, 2048])
def test_near_copies_around_the_threshold(spark, monkeypatch, block):
    """Most pairs of such copies are just under 0.8, so buckets hold many components and are examined in blocks."""
    monkeypatch.setattr(minhash_dedup, "BLOCK_MEMBERS", block)
    import random

    rng = random.Random(9)
    base = [f"w{i}" for i in range(146)]
    rows = []
    for n in range(420):
        words = list(base)
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(len(words))] = f"e{n}_{rng.randrange(10**6)}"
        rows.append((n, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows, 5)
    assert len({c for _, c in got.values()}) > 5


def test_intersections_by_matrix():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 4000)).astype(np.uint64)) for _ in range(20)] + [np.empty(0, np.uint64)]
    got = intersections(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert i == j or got[i, j] == len(np.intersect1d(a, b))


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d e f", "x"), (5, "a b c d e f", "y"), (5, "a b c d e f", "y"), (7, "a b c d e f", None), (9, None, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, component_id string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, None, True), (5, 5, True), (5, 5, True), (7, 5, False), (9, 9, True)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0


def brute_lines(rows, min_words):
    first, out = {}, {}
    for i, t in sorted(rows):
        keep, spans, at = [], [], 0
        for n, line in enumerate((t or "").split("\n")):
            form = " ".join(line.lower().split())
            after = at + len(line) + 1
            if len(form.split()) >= min_words and first.setdefault(form, (i, n)) != (i, n):
                spans.append((at, min(after, len(t))))
            else:
                keep.append(line)
            at = after
        out[i] = (None if t is None else "\n".join(keep), spans)
    return out


def test_repeated_lines_match_brute_force(spark):
    docs = spark.read.parquet(DOCS)
    got = {r.doc_id: (r.text, [tuple(x) for x in r.removed]) for r in remove_repeated_units(docs).collect()}
    assert got == brute_lines([(r.doc_id, r.text) for r in docs.collect()], 5)
    assert any(s for _, s in got.values())


def test_repeated_units_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"a\n{long}\nb"), (2, f"{long}"), (3, f"é\n{long.upper()}  \n\nz"), (4, None), (5, ""), (6, "short line\nshort line"), (2, long), (None, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit("s"), "n_removed": F.lit("clash")})
    got = sorted(((r.doc_id, r.text, r.n_removed, r.n_units) for r in remove_repeated_units(df).collect()), key=str)
    assert got == sorted([(1, f"a\n{long}\nb", 0, 1), (2, "", 1, 1), (2, "", 1, 1), (3, "é\n\nz", 1, 1), (4, None, 0, 0), (5, "", 0, 0), (6, "short line\nshort line", 0, 0), (None, "", 1, 1)], key=str)
    assert remove_repeated_units(df.limit(0)).count() == 0
    para = remove_repeated_units(spark.createDataFrame([(1, f"{long}\n\nq"), (2, f"r\n\n{long}\n\nt")], "doc_id long, text string"), unit="paragraph")
    assert {r.doc_id: r.text for r in para.collect()} == {1: f"{long}\n\nq", 2: "r\n\nt"}


def test_components_of_random_graphs(spark):
    import random

    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_large_bucket_is_not_multiplied(spark, monkeypatch):
    """50,000 members of which all but one are linked: each meets the odd one, and only texts that may match are fetched."""
    n, words = 50_000, " ".join(f"w{i}" for i in range(30))
    near = F.col("__id") % 1000 == 0
    ids = spark.range(n).withColumnRenamed("id", "__id")
    sig = F.when(near | (F.col("__id") == n - 1), F.unhex(F.lit("07" * 256))).otherwise(F.unhex(F.lit("01" * 256)))
    base = ids.select("__id", sig.alias("sig"), F.array_repeat(F.lit(5).cast("bigint"), 32).alias("bands"))
    texts = ids.select("__id", F.when(near | (F.col("__id") == n - 1), F.lit(words)).otherwise(F.lit("other")).alias("__text"))
    members = ids.select(F.lit(9).cast("bigint").alias("bucket"), F.lit(0).alias("band"), "__id", F.when(F.col("__id") == n - 1, n - 1).otherwise(0).cast("bigint").alias("root"))
    mixed = spark.createDataFrame([(9, 0, -(-n // minhash_dedup.BLOCK_MEMBERS), 1)], "bucket long, main long, n_home long, n_away long")
    fetched = []

    def spy(df, tag):
        out = minhash_dedup.storage_materialize(df, tag)
        fetched.append((tag, out.count()))
        return out

    monkeypatch.setattr(minhash_dedup, "storage_materialize", minhash_dedup.materialize, raising=False)
    monkeypatch.setattr(minhash_dedup, "materialize", spy)
    links = minhash_dedup._explore(members, mixed, base, texts, 5, 80).collect()
    assert {(max(r.u, r.v), min(r.u, r.v) % 1000) for r in links} == {(n - 1, 0)}
    assert len(fetched) == 1 and fetched[0][1] <= 2 * n // 1000  # 50 members and, in their blocks, the odd one


def test_near_duplicates_of_very_long_texts(spark):
    """Two texts of 150,000 words that differ at their ends only, and one that shares half of them."""
    words = [f"w{k * k % 1_000_003}" for k in range(150_000)]
    texts = [" ".join(words), " ".join([*words[:140_000], *(f"x{k}" for k in range(10_000))]), " ".join([*words[:75_000], *(f"y{k}" for k in range(75_000))])]
    sets = [{tuple(t.split()[k : k + 2]) for k in range(149_999)} for t in texts]
    assert 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1]) and 100 * len(sets[0] & sets[2]) < 80 * len(sets[0] | sets[2])
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shingle_words=2, percent=80).collect()}
    assert [got[k].component_id for k in range(3)] == [0, 0, 2] and [got[k].n_shingles for k in range(3)] == [len(s) for s in sets]
