"""Spelling variants against a comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm.spelling import parity_masks, spelling_variants
from tests.llm.test_dedup import DOCS

BANDS = [(1 << 21) - 1 << 21 * b for b in range(3)]


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows, min_length=5, min_count=3, ratio=2, noise=97):
    lower = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    n = Counter()
    for i, t in rows:
        for w in re.findall("[a-zÀ-ÿ]+", (t or "").translate(lower)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % noise == 0 else w] += 1
    words = {w: k for w, k in n.items() if len(w) >= min_length and k >= min_count}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


def found(df, **more):
    return {tuple(r) for r in spelling_variants(df, **more).collect()}


@settings(max_examples=300, deadline=None)
@given(st.text("abcxyzéàÿ÷", min_size=1, max_size=12), st.text("abcxyzéàÿ÷", min_size=1, max_size=12))
def test_one_edit_leaves_a_band(a, b):
    x, y = (int(m) for m in parity_masks([a, b]))
    if one_edit(a, b):
        assert bin(x ^ y).count("1") <= 2 and any((x ^ y) & m == 0 for m in BANDS)


def test_masks_of_no_words():
    assert len(parity_masks([])) == 0


@pytest.mark.parametrize("more", [{}, {"min_length": 2, "min_count": 1}, {"ratio": 3, "noise": 2}])
def test_random_vocabulary(spark, more):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdeéÿ") for _ in range(rng.randrange(2, 11))) for _ in range(120)]

    def vary(w):
        k, c = rng.randrange(len(w)), rng.choice("abéZ")
        return rng.choice([w, w, w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])

    rows = [(i, "1 ".join(vary(rng.choice(base)) for _ in range(rng.randrange(40)))) for i in range(200)] + [(None, "abcde " * 9 + "ABCDÉ"), (7, None), (8, ""), (9, "x" * 30_000), (10, "y1" * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("w"), "n": F.lit(0), "key": F.lit(1)}).repartition(5)
    assert found(df, **more) == plain(rows, **more)


def test_documents_match_all_pairs(spark):
    docs = spark.read.parquet(DOCS).where("doc_id < 60")
    assert found(docs) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_chains_ties_and_repeated_rows(spark):
    words = {"abcdea": 3, "abcdeb": 6, "abcdec": 6, "abcdefc": 12, "abcdefgc": 24, "zzzzz": 3}
    rows = [(0, " ".join(w for w, n in words.items() for _ in range(n)))]
    got = {r.word: r for r in spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), noise=10**9).collect()}
    assert (got["abcdea"].form, got["abcdea"].root) == ("abcdeb", "abcdeb")  # a tie goes to the smaller word
    assert (got["abcdec"].form, got["abcdec"].root, got["abcdec"].form_n) == ("abcdefc", "abcdefgc", 12)
    assert (got["zzzzz"].form, got["zzzzz"].root, got["zzzzz"].n_near) == (None, "zzzzz", 0)
    twice = spark.createDataFrame([(1, "tabler tabler"), (1, "tabler tabler")], "doc_id long, text string")
    assert [(r.word, r.n) for r in spelling_variants(twice, noise=10**9).collect()] == [("tabler", 4)]
    assert spelling_variants(twice.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling_variants(twice, ratio=1)
