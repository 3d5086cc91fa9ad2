"""Operator 8: token ids against the tokenizers library, exact cover, and the program against brute force."""

import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm.packing import best_cuts, pack_documents, tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet=" <|endoftext|>\n\tab'sé.1", max_size=40))
def test_ids_are_the_librarys(text):
    assert tokenizer(PATH).encode(text).tolist() == LIB.encode(text, add_special_tokens=False).ids


def test_special_token_in_a_text():
    text = "a <|endoftext|> b<|endoftext|>"
    assert tokenizer(PATH).encode(text).tolist() == LIB.encode(text, add_special_tokens=False).ids


def window_cost(n, limit, per):
    return per + (0 if n & (n - 1) == 0 else limit - n)


def test_program_is_optimal():
    rng = random.Random(5)
    for _ in range(300):
        limit = rng.choice([8, 16, 13])
        points = [0]
        while len(points) < rng.randint(2, 25):
            points.append(points[-1] + rng.randint(1, limit))
        prices = [rng.choice([0, 1, 5]) for _ in points]
        cuts = best_cuts(points, prices, limit, 2)
        price = dict(zip(points, prices, strict=True))
        cost = sum(window_cost(b - a, limit, 2) + price[b] for a, b in zip(cuts, cuts[1:], strict=False))
        assert cuts[0] == 0 and cuts[-1] == points[-1] and all(b - a <= limit for a, b in zip(cuts, cuts[1:], strict=False))

        @lru_cache(None)
        def best(k, points=tuple(points), price=tuple(prices), limit=limit):
            return min((best(j) + window_cost(points[k] - points[j], limit, 2) + price[k] for j in range(k) if points[k] - points[j] <= limit), default=0) if k else 0

        assert cost == best(len(points) - 1)


def check(rows, texts, limit=1024):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = np.array([*LIB.encode(texts[i] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    used = padded = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= limit
        used += at
        padded += 0 if at & (at - 1) == 0 else limit - at
    return padded / used


def test_operator(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    share = check(pack_documents(docs, vocabulary=PATH).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert share < 0.02


def test_operator_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x" * 20000), (4, "\n" * 5000), (5, "a. " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as start", "1 as offset")
    check(pack_documents(df, vocabulary=PATH).collect(), dict(rows))
    both = pack_documents(spark.createDataFrame([(None, "a"), (7, "b"), (7, "b")], "doc_id long, text string"), vocabulary=PATH).collect()
    assert sorted(((r.doc_id, r.length) for r in both), key=str) == sorted([(None, 2), (7, 2), (7, 2)], key=str)
    assert pack_documents(df.limit(0), vocabulary=PATH).count() == 0
