"""Suffix order against sorting, repeated strings against a set of all strings."""

import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import suffix_dedup
from ledgerloom.llm.queries import op13_suffix_dedup
from ledgerloom.llm.suffix_dedup import Compared, excerpts_of, remove_repeated_strings
from ledgerloom.llm.suffix_order import suffix_order
from tests.llm.test_dedup import DOCS


def brute(texts, width):
    """(n_bytes, n_removed, n_spans, kept) of each text, by a count of all strings."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[k : k + width] for t in data for k in range(len(t) - width + 1))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if seen[t[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return out


def found(spark, texts, width, parts=3):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumns({"print": F.lit("x"), "block": F.lit(1), "k1": F.lit(None)})
    rows = {r.doc_id: r for r in remove_repeated_strings(df.repartition(parts), width=width).collect()}
    for k, t in enumerate(texts):
        data, at, kept = (t or "").encode(), 0, b""
        for s in rows[k].removed:
            kept, at = kept + data[at : s.start], s.end
        assert kept + data[at:] == bytes(rows[k].kept)
    return [(rows[k].n_bytes, rows[k].n_removed, rows[k].n_spans, bytes(rows[k].kept)) for k in range(len(texts))]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.integers(1, 5))
def test_suffix_order(symbols, times):
    text = [*symbols * times, 0]
    assert suffix_order(text) == sorted(range(len(text)), key=lambda k: text[k:])


def varied(rng, n):
    """Texts with shared runs at odd places, copies, near copies and periods."""
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 9)))
    own = lambda k: "".join(word() for _ in range(rng.randrange(k + 1)))
    shared = [own(60) for _ in range(6)] + ["ab" * 90, "x" * 150, "line of equal text. " * 4]
    texts = [None, "", "short"]
    for _ in range(n):
        parts = [own(12), rng.choice(shared)[rng.randrange(9) :], own(rng.randrange(20)), rng.choice(shared)]
        t = "".join(parts)
        if texts[-1] and rng.random() < 0.4:
            t = texts[-1]
            for _ in range(rng.randrange(4)):
                k = rng.randrange(max(len(t), 1))
                t = t[:k] + rng.choice(["", "Q", "zz"]) + t[k + 1 :]
        texts.append(t)
    return texts


@pytest.mark.parametrize("width", [32, 40, 64, 200])
def test_random_texts(spark, width):
    texts = varied(random.Random(width), 150)
    assert found(spark, texts, width) == brute(texts, width)


def test_small_blocks_chunks_and_dealt_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 12)
    monkeypatch.setattr(suffix_dedup, "SHARE", 3)
    rng = random.Random(9)
    line = "a line that very many documents have in common, and nothing else."
    texts = varied(rng, 60) + [f"{rng.randrange(10**9)} {line} {rng.randrange(10**9)}" for _ in range(120)] + [f"{k % 7}0 {line} {k % 5}1" for k in range(40)]
    assert found(spark, texts, 40) == brute(texts, 40)


def test_long_texts_go_in_pieces(spark, monkeypatch):
    rng = random.Random(10)
    base = "".join(rng.choice("abcdefghij") for _ in range(40_000))
    texts = [base, base[10_000:10_300], "-" + base[20_000:20_210] + "+", "z" * 3000, base[:50] + base[500:700]]
    want = brute(texts, 200)
    assert found(spark, texts, 200) == want
    pieces = [(r, o, p) for row, offset, piece in suffix_dedup._pieces([t.encode() for t in texts], 200) for r, o, p in zip(row, offset, piece, strict=True)]
    assert len(pieces) == len(texts)
    small = {"CHUNK": 1000}
    monkeypatch.setattr(suffix_dedup, "CHUNK", small["CHUNK"])
    cut = [(r, o, p) for row, offset, piece in suffix_dedup._pieces([t.encode() for t in texts], 200) for r, o, p in zip(row, offset, piece, strict=True)]
    starts = sorted((r, o + k) for r, o, p in cut for k in range(len(p) - 199))
    assert starts == [(r, k) for r, t in enumerate(texts) for k in range(len(t) - 199)]


def test_kernel_and_excerpts():
    rng = random.Random(11)
    texts = [t.encode() for t in varied(rng, 40) if t]
    owner, start, windows, anchor, _, _ = (x.tolist() for x in excerpts_of(texts, 64))
    assert sorted((o, s + k) for o, s, w in zip(owner, start, windows, strict=True) for k in range(w)) == [(o, k) for o, t in enumerate(texts) for k in range(len(t) - 63)]
    pieces = [texts[o][s : s + w + 63] for o, s, w in zip(owner, start, windows, strict=True)]
    found = Compared(pieces, anchor, windows, 64, suffix_order)
    strings = [p[k : k + 64] for p, w in zip(pieces, windows, strict=True) for k in range(w)]
    times = Counter(strings)
    assert found.repeated.tolist() == [times[s] > 1 for s in strings]
    assert (~found.again).sum() == len(times)


def test_documents_match_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(DOCS).collect()]
    want = {i: (n, g, s, hashlib.sha256(k).hexdigest()) for (i, _), (n, g, s, k) in zip(rows, brute([t for _, t in rows], 200), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op13_suffix_dedup(spark, DOCS.rpartition("/")[0]).collect()} == want


def test_repeated_rows_ids_and_no_rows(spark):
    text = "".join(chr(97 + k * k % 23) + str(k) for k in range(90))
    df = spark.createDataFrame([("a", text), ("a", text), (None, "other " * 3)], "name string, text string")
    assert sorted((r.name or "", r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeated_strings(df, id_col="name").collect()) == [
        ("", 18, 0, 0), ("a", len(text), len(text), 1), ("a", len(text), len(text), 1)]
    assert remove_repeated_strings(df.limit(0), id_col="name").count() == 0
    with pytest.raises(ValueError):
        remove_repeated_strings(df, id_col="name", width=100)
