"""Operator 9: the recursions against enumeration, the counts against brute force, and held-out gain."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.hmm_model import Hmm, Sequences, Symbols, most_frequent, train_and_score


def model(rng, s, m):
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return Hmm(norm(rng.random(s), 0), norm(rng.random((s, s)), 1), norm(rng.random((m, s)), 0))


def test_forward_and_expected_counts_by_enumeration():
    rng = np.random.default_rng(0)
    m = model(rng, 3, 5)
    parts = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 2, 5, 1, 3)]
    start, moves, emits, logs = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)), []
    for p in parts:
        paths = {}
        for z in itertools.product(range(3), repeat=len(p)):
            w = m.start[z[0]] * m.emit[p[0], z[0]]
            for t in range(1, len(p)):
                w *= m.move[z[t - 1], z[t]] * m.emit[p[t], z[t]]
            paths[z] = w
        total = sum(paths.values())
        logs.append(math.log10(total))
        for z, w in paths.items():
            start[z[0]] += w / total
            for t in range(len(p)):
                emits[p[t], z[t]] += w / total
                if t:
                    moves[z[t - 1], z[t]] += w / total
    s = Sequences(parts)
    assert np.allclose(s.likelihoods(m), logs)
    for got, want in zip(s.expected(m), (start, moves, emits), strict=True):
        assert np.allclose(got, want)


def brute(rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, t in rows if not held[i] for w in words(t))
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t))) for i, t in rows}


@pytest.mark.parametrize("dictionary", [200_000, 3000])
def test_operator(spark, dictionary):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = train_and_score(docs, dictionary=dictionary, top=2000, rounds=2, sample_rounds=8).collect()
    assert len(got) == len(want)
    base = score = 0
    for r in got:
        held, n, known, total, b = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(b, rel=1e-9)
        if held:
            base, score = base + r.base_score, score + r.score
    assert score > base + 0.02 * abs(base)


def test_distribution_adds_up_to_one(spark):
    """With one state tokens are independent, so a word's probability is its text's over the empty text's. All words, one unseen
    word of each class, which has all that its class leaves to unseen words, and the end add up to 1."""
    rows = [(k, "a b c" if k % 2 else "x y z zz") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    classes, unseen = 4, {}
    for k in range(200):
        unseen.setdefault(Symbols(3, classes).of_class(b"q%d" % k), f"q{k}")
    assert len(unseen) == classes
    words = ["a", "b", "c", "x", "y", "z", "zz", *unseen.values(), ""]
    both = df.union(spark.createDataFrame([(1000 + k, w) for k, w in enumerate(words)], "doc_id long, text string"))
    for dictionary in (5, 0, 100):
        out = train_and_score(both, held_out=F.col("__id") >= 1000, top=3, classes=classes, dictionary=dictionary, states=1, sample_rounds=3, rounds=1).collect()
        p = {r.doc_id: 10**r.score for r in out}
        end = p[999 + len(words)]
        assert sum(p[1000 + k] / end for k in range(len(words) - 1)) + end == pytest.approx(1, abs=1e-6)


def test_scores_with_rare_words_by_brute_force(spark):
    """One state: the count of a symbol, with the prior, times a rare word's share of its class."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    top, classes, dictionary, prior = 40, 16, 64, 200.0
    got = {r.doc_id: r for r in train_and_score(docs, top=top, classes=classes, dictionary=dictionary, states=1, sample_rounds=2, rounds=2).collect()}
    words = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    train = [t for i, t in texts.items() if not got[i].held_out]
    c = Counter(w for t in train for w in t)
    counts = spark.createDataFrame(list(c.items()), "word string, c long").where(F.octet_length("word") <= 64)
    book = most_frequent(counts, dictionary)["word"].to_pylist()
    symbols, place = Symbols(top, classes), {w: 1 + k for k, w in enumerate(book[:top])}
    symbol = lambda w: place.get(w) or symbols.of_class(w.encode())
    seen, total, base = Counter(), Counter(), Counter({0: len(train) + 1})
    for w, n in c.items():
        seen[symbol(w)] += n
        base[symbol(w)] += n + 1
        if w not in place:
            total[symbol(w)] += n + 1
    seen[0] = len(train)
    for k in range(1 + top, symbols.size):
        total[k] += 1
        base[k] += 1
    n, all_base = sum(seen.values()), sum(base.values())
    p = lambda s: (seen[s] + prior * base[s] / all_base) / (n + prior)
    for i, t in texts.items():
        want = math.log10(p(0)) + sum(math.log10(p(symbol(w)) * (1 if w in place else (c[w] + 1) / total[symbol(w)])) for w in t)
        assert got[i].score == pytest.approx(want, rel=1e-5)


def test_most_frequent_words(spark):
    counts = {f"w{k}": 1 + (k * k) % 97 + (5000 if k < 7 else 0) for k in range(3000)}
    df = spark.createDataFrame(list(counts.items()), "word string, c long")
    for limit in (0, 5, 200, 1500, 2999, 4000):
        got = most_frequent(df, limit).to_pylist()
        assert len(got) == min(limit, 3000) and all(counts[r["word"]] == r["c"] for r in got)
        assert [r["c"] for r in got] == sorted((r["c"] for r in got), reverse=True)
        if limit == 1500:  # the cut is below 64, where levels are exact
            assert [r["c"] for r in got] == sorted(counts.values(), reverse=True)[:limit]


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a"), (4, "a b"), (4, "a b"), (5, "x" * 50_000)], "doc_id long, text string").selectExpr("*", "1 as held", "'x' as score")
    got = sorted(((r.doc_id, r.n_tokens) for r in train_and_score(df).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (None, 2), (4, 3), (4, 3), (5, 2)], key=str)
    assert train_and_score(df.limit(0)).count() == 0
