"""Operators 3 and 4 by held-out accuracy, and on odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm.labels import crc_of_id, fetch_features
from ledgerloom.llm.queries import op3_quality_classifier
from ledgerloom.llm.quality_model import Features, SubwordClassifier, score_quality
from ledgerloom.llm.toxicity_chain import ClassifierChain, Presence, kinds_of, score_toxicity

DIR = "/root/testdata/sf0.1"


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    held = F.pmod(crc_of_id("doc_id"), F.lit(4)) == 2
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = {r.doc_id: r.predicted for r in score_quality(some, labels, where=~held).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert np.mean([got[i] == q for i, q in truth.items()]) > 0.97


def test_averaging_is_exact():
    f = Features(bits=10)
    rows = [f.sparse(t) for t in (b"a b a b a b", b"some words here", b"", b"x")]
    m = SubwordClassifier.fit(rows, np.array([0, 1, 1, 1]), f, epochs=3)
    gain, bias = m.projected()
    for ids, weights in rows:
        z = (weights @ m.vectors[ids]) @ m.output + m.bias if len(ids) else m.bias
        assert weights @ gain[ids] + bias == pytest.approx(float(z[1] - z[0]), abs=1e-4)
        assert not len(ids) or weights.sum() == pytest.approx(1, abs=0.51)


def test_toxicity_on_other_rows(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    training = F.pmod(crc_of_id("doc_id"), F.lit(3)) != 0
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = {r.doc_id: r for r in score_toxicity(some, labels, where=training).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 0}
    caught = np.mean([got[i].predicted for i, t in truth.items() if t])
    wrong = np.mean([got[i].predicted for i, t in truth.items() if not t])
    assert caught > 0.8 and wrong < 0.01
    assert all(r.kept == (r.predicted == 0) and r.score == r.p_toxic for r in got.values())


MASK = 2**64 - 1


def mix_(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


STEP = 0x9E3779B97F4A7C15
TEXTS = [b"The idiot says: the idiot!", b"a b a b a b c", "Schöne Grüße, du Trottel".encode(), b"", None, b"one", b"x y z\n\tx y z x y z", b"aa " * 40]


def test_quality_features_by_plain_loops():
    f = Features(bits=12)
    half = f.size // 2
    for text in TEXTS:
        words = [xxhash.xxh3_64_intdigest(w) for w in (text or b"").split()]
        first, second = Counter(), Counter()
        for w in words:
            first[mix_(w) >> (65 - f.bits)] += 1
        grams = words
        for order in (2, 3):
            grams = [(mix_(g) * STEP + w) & MASK for g, w in zip(grams, words[order - 1 :], strict=False)]
            if order == 2:
                first.update(mix_(g) >> (65 - f.bits) for g in grams)
            if len(grams) > len(set(grams)):
                first[order] += len(grams) - len(set(grams))
        raw = b" " + (text or b"") + b" "
        for order in (3, 4, 5):
            for at in range(len(raw) - order + 1):
                piece = raw[at : at + order]
                if text and all(c > 32 for c in piece[1:-1]):
                    h = order
                    for c in piece:
                        h = (h * STEP + (32 if c <= 32 else c)) & MASK
                    second[half + (mix_(h) >> (65 - f.bits))] += 1
        want = {k: 0.5 * n / sum(part.values()) for part in (first, second) for k, n in part.items()}
        ids, weights = f.sparse(text)
        assert dict(zip(ids.tolist(), weights.tolist(), strict=True)) == pytest.approx(want, rel=1e-6)


def test_one_epoch_of_descent_by_plain_loops():
    f, dim, rate, seed = Features(bits=8), 3, 4.0, 5
    rows, labels = [f.sparse(t) for t in TEXTS], np.array([0, 1, 0, 1, 1, 0, 1, 0])
    m = SubwordClassifier.fit(rows, labels, f, dim=dim, epochs=1, rate=rate, seed=seed)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (f.size, dim)).astype(np.float32).astype(float).tolist()
    output = rng.normal(0, 0.5, (dim, 2)).astype(np.float32).astype(float).tolist()
    bias = [math.log(0.5), math.log(0.5)]
    for step, k in enumerate(rng.permutation(len(rows))):
        lr = rate * (1 - step / len(rows))
        pairs = list(zip(rows[k][0].tolist(), rows[k][1].tolist(), strict=True))
        hidden = [sum(w * vectors[i][d] for i, w in pairs) for d in range(dim)]
        z = [sum(hidden[d] * output[d][c] for d in range(dim)) + bias[c] for c in (0, 1)]
        p = [math.exp(x - max(z)) for x in z]
        wrong = [p[c] / sum(p) - (labels[k] == c) for c in (0, 1)]
        back = [sum(output[d][c] * wrong[c] for c in (0, 1)) for d in range(dim)]
        for d in range(dim):
            for c in (0, 1):
                output[d][c] -= 0.1 * lr * hidden[d] * wrong[c]
        bias = [bias[c] - 0.02 * lr * wrong[c] for c in (0, 1)]
        for i, w in pairs:
            vectors[i] = [vectors[i][d] - lr * w * back[d] for d in range(dim)]
    assert np.allclose(m.vectors, vectors, atol=1e-4) and np.allclose(m.output, output, atol=1e-4) and np.allclose(m.bias, bias, atol=1e-5)


def test_quality_scores_of_the_query_by_plain_loops(spark):
    """The registered query's scores are those of the model fitted on the same rows, document by document."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = sorted((r.doc_id, r.quality) for r in labels.collect() if r.doc_id in text and r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2)
    f = Features()
    m = SubwordClassifier.fit([f.sparse(text[i]) for i, _ in rows], np.array([q for _, q in rows]), f)
    got = op3_quality_classifier(spark, d).collect()
    assert len(got) == len(text)
    for r in got:
        ids, weights = f.sparse(text[r.doc_id])
        z = m.bias + sum((w * (m.vectors[i] @ m.output) for i, w in zip(ids.tolist(), weights.tolist(), strict=True)), np.zeros(2))
        assert r.score == pytest.approx(1 / (1 + math.exp(z[0] - z[1])), abs=1e-4)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7)


def test_toxicity_features_by_plain_loops():
    f = Presence(bits=14)
    for text in TEXTS:
        want = set()
        for word in re.findall(rb"[0-9a-z\x80-\xff]+", (text or b"").lower()):
            want.add(mix_(xxhash.xxh3_64_intdigest(word)) >> (64 - f.bits))
            h = 17
            for k, c in enumerate(word[:8]):
                h = (h * STEP + c) & MASK
                if k + 1 in f.prefixes:
                    want.add(mix_((h + k) & MASK) >> (64 - f.bits))
        assert f.of(text).tolist() == sorted(want)


def plain_fit(rows, extra, y):
    """Weights by bucket, of the earlier probabilities, and the bias: the likelihood's maximum with a ridge, by small Newton steps."""
    n, n1 = len(rows), sum(y)
    if n1 in (0, n):
        return {}, [0.0] * len(extra[0]), 8.0 if n1 else -8.0
    g = {}
    for b in set().union(*rows):
        g[b] = 0.0
        have = sum(b in r for r in rows)
        for cls, size in ((1, n1), (0, n - n1)):
            seen = sum(b in r for r, v in zip(rows, y, strict=True) if v == cls)
            for s, mean in ((seen, have * size / n), (size - seen, size - have * size / n)):
                g[b] += 2 * s * math.log(s / mean) if s else 0.0
        if have < 4:
            g[b] = 0.0
    chosen = sorted(b for b in sorted(g, key=lambda b: (-g[b], b))[:256] if g[b] >= 12)
    x = np.array([[float(b in r) for b in chosen] + list(e) + [1.0] for r, e in zip(rows, extra, strict=True)])
    penalty = np.array([0.3] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    w[-1] = math.log(n1 / (n - n1))
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 0.5 * np.linalg.solve(x.T @ np.diag(p * (1 - p)) @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
    return dict(zip(chosen, w, strict=False)), w[len(chosen) : -1].tolist(), w[-1]


def plain_p(model, row, earlier):
    z = model[2] + sum(model[0].get(b, 0.0) for b in row) + sum(a * b for a, b in zip(model[1], earlier, strict=True))
    return 1 / (1 + math.exp(-z))


def plain_chain(rows, targets, folds):
    """The chain's models; with ``folds`` None the earlier probabilities come from the model itself."""
    extra, models = [[] for _ in rows], []
    for c in range(len(targets[0])):
        y = [t[c] for t in targets]
        models.append(plain_fit(rows, extra, y))
        made = []
        for k, (r, e) in enumerate(zip(rows, extra, strict=True)):
            keep = [j for j in range(len(rows)) if folds is None or j % folds != k % folds]
            made.append((k % folds if folds else 0, keep, r, e))
        fitted = {f: plain_fit([rows[j] for j in keep], [extra[j] for j in keep], [y[j] for j in keep]) for f, keep in {f: keep for f, keep, _, _ in made}.items()} if c + 1 < len(targets[0]) else {}
        extra = [[*e, plain_p(fitted[f], r, e)] for f, _, r, e in made] if fitted else extra
    return models


def test_chain_by_plain_loops():
    """Out-of-fold probabilities, in order; in-fold ones give other models."""
    rng = random.Random(8)
    f = Presence(bits=16, prefixes=(8,))
    texts, targets = [], []
    for _ in range(90):
        words = rng.sample([f"w{k}" for k in range(12)], 5)
        flip = lambda x: x != (rng.random() < 0.12)
        one, two = flip("w0" in words or "w1" in words), flip("w2" in words or "w3" in words)
        texts.append(" ".join(words).encode())
        targets.append([int(one), int(two), int(flip(one or two))])
    rows = [f.of(t) for t in texts]
    chain = ClassifierChain.fit(rows, np.array(targets), 1 << 16)
    sets = [set(r.tolist()) for r in rows]
    got, asked = chain.predict(rows), {}
    for folds in (5, None):
        models, asked[folds] = plain_chain(sets, targets, folds), []
        for s in sets:
            p = []
            for m in models:
                p.append(plain_p(m, s, p))
            asked[folds].append(p)
    assert np.allclose(got, asked[5], atol=2e-3)
    assert np.abs(got - np.array(asked[None])).max() > 0.05
    assert [len(m.chain) for m in chain.models] == [0, 1, 2] and all(abs(x) > 0.1 for x in chain.models[2].chain)


def test_kinds_are_degrees_within_a_group():
    f = Presence(bits=16)
    rng = random.Random(2)
    words = {lang: [f"{lang}{k}" for k in range(50)] for lang in ("one", "two")}
    bad = {"one": ["idiot", "moron", "scum", "loser"], "two": ["trottel", "depp", "idiotisch", "dumm"]}
    texts, y, lang, form = [], [], [], []
    for k in range(400):
        own, toxic, long, full = ("one", "two")[k % 2], k % 4 < 2, k % 8 < 4, k % 16 < 8
        texts.append(" ".join(rng.sample(words[own], 40 if long else 12) + rng.sample(bad[own], (4 if full else 1) if toxic else 0)).encode())
        y.append(int(toxic))
        lang.append(own)
        form.append((long, full))
    got = kinds_of([f.of(t) for t in texts], np.array(y), 1 << 16, 4)
    assert set(got[np.array(y) == 0]) == {-1} and set(got[np.array(y) == 1]) == {0, 1, 2, 3}
    for own in words:  # a language's toxic texts are of all kinds
        kinds = [g for g, w, t in zip(got.tolist(), lang, y, strict=True) if w == own and t]
        assert np.bincount(kinds, minlength=4).max() <= 0.6 * len(kinds)
    full = [x[1] for g, x in zip(got.tolist(), form, strict=True) if g in (1, 3)]
    assert sum(full) > 0.6 * len(full)
    rows = [f.of(t) for t in texts[:200]]
    assert kinds_of(rows, np.zeros(200, int), 1 << 16, 4).tolist() == [-1] * 200
    assert kinds_of(rows, np.ones(200, int), 1 << 16, 4).tolist() == [0] * 200


def test_kinds_are_no_languages_and_the_chain_helps():
    """On the larger documents, every third one held out: no kind has over 90 % of a language's toxic texts, and the chain lowers the last link's log loss."""
    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text", "lang"]).to_pandas()
    known = docs.merge(pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pandas(), on="doc_id").sort_values("doc_id")
    f = Presence()
    rows, y, lang = [f.of((t or "").encode()) for t in known.text], known.toxic.to_numpy().astype(int), known.lang.to_numpy()
    held = np.arange(len(y)) % 3 == 2
    seen, width = [r for r, h in zip(rows, held, strict=True) if not h], 1 << f.bits
    kind = kinds_of(seen, y[~held], width, 4)
    for own in set(lang):
        of = kind[(lang[~held] == own) & (kind >= 0)]
        assert len(of) < 10 or np.bincount(of).max() <= 0.9 * len(of)

    def loss(targets):
        p = np.clip(ClassifierChain.fit(seen, targets, width).predict([r for r, h in zip(rows, held, strict=True) if h])[:, -1], 1e-6, 1 - 1e-6)
        return -np.mean(np.where(y[held] == 1, np.log(p), np.log(1 - p)))

    chained = loss(np.column_stack([*((kind == k).astype(int) for k in range(4)), y[~held]]))
    assert chained < loss(y[~held][:, None])


def test_training_features_are_bounded(spark):
    made = spark.createDataFrame([(k, k % 2, list(range(10 if k % 5 else 1000))) for k in range(50)], "__id long, label int, ids array<int>")
    every, order = fetch_features(made)
    assert [every["__id"].to_pylist()[k] for k in order] == list(range(50))
    few, order = fetch_features(made, most=500)
    assert [few["__id"].to_pylist()[k] for k in order] == [k for k in range(50) if k % 5]


@pytest.mark.parametrize("score", [lambda d, t: score_quality(d, t), lambda d, t: score_toxicity(d, t)])
def test_very_long_texts(spark, score):
    """A text of two million characters is read to its end."""
    rng = random.Random(6)
    good, bad = [f"g{k}" for k in range(40)], [f"b{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choices(bad if k % 2 else good, k=30))) for k in range(200)]
    filler = " ".join(f"x{rng.randrange(300)}" for _ in range(400_000))
    docs = spark.createDataFrame([*rows, (900, filler + " " + " ".join(bad * 3000)), (901, filler + " " + " ".join(good * 3000)), (902, filler)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(200)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in score(docs, labels).collect()}
    assert got[900] > got[902] > got[901]


@pytest.mark.parametrize("score", [lambda d, t: score_quality(d, t), lambda d, t: score_toxicity(d, t)])
def test_odd_rows(spark, score):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b"), (4, "a b"), (4, "a b"), (5, "x" * 50_000), (6, "é ü !!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as score", "1 as label", "2 as ids")
    labels = spark.createDataFrame([(4, 1, 1), (4, 1, 1), (6, 0, 0), (5, None, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    got = score(docs, labels).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((r[0] for r in rows), key=str)
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert score(docs.limit(0), labels).count() == 0
    assert score(docs, labels.limit(0)).count() == len(rows)
