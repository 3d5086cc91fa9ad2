"""Operator 10 against greedy longest-first matching by substring lookup."""

import json
import unicodedata

import public_tokenizers
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm.wordpiece_counts import LongestMatchCounter, wordpiece_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


def greedy(word, initial, inner):
    at, n, pieces = 0, 0, initial
    while at < len(word):
        end = len(word)
        while end > at and word[at:end] not in pieces:
            end -= 1
        if end == at:
            return 1
        at, n, pieces = end, n + 1, inner
    return n


def greedy_with_end(word, inner, final):
    """The longest piece each time: of ``final`` for the whole rest, of ``inner`` for less."""
    at, n = 0, 0
    while at < len(word):
        end = len(word)
        while word[at:end] not in (final if end == len(word) else inner):
            end -= 1
        at, n = end, n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), max_size=12), st.sets(st.text("abc", min_size=1, max_size=5), max_size=12), st.lists(st.text("abcd", max_size=14), max_size=8))
def test_automaton(initial, inner, words):
    c = LongestMatchCounter(initial, inner)
    assert [c.count(w) for w in words] == [greedy(w, initial, inner) for w in words]


def test_long_words_are_linear():
    c = LongestMatchCounter({"a" * n for n in range(1, 60)}, {"a" * n for n in range(1, 60)})
    assert c.count("a" * 200_000) == -(-200_000 // 59)


def test_operator(spark):
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    vocab = [(bytes(back[c] for c in p.removesuffix("</w>")), p.endswith("</w>")) for p in json.load(open(PATH))["model"]["vocab"]]
    final, inner = ({p for p, end in vocab if end is e} for e in (True, False))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    docs = docs.union(spark.createDataFrame([(-1, "theforce theforced twentyonepilots xtwentyonepilotsx GRO\u0308SSE cafe\u0301 it's 2024 ...")], "doc_id long, text string").select("doc_id", "text", F.lit("en"), F.lit("s"), F.lit(1)))
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in wordpiece_counts(docs, vocabulary=PATH).collect()}
    plain = 0
    for r in docs.collect():
        words = [w.encode() for w in regex.findall(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", unicodedata.normalize("NFC", r.text).lower())]
        assert got[r.doc_id] == (len(words), sum(greedy_with_end(w, inner, final) for w in words))
        plain += sum(greedy_with_end(w, inner | final, inner | final) for w in words)
    assert plain < sum(n for _, n in got.values())  # the marks matter


def test_operator_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (None, "a"), (4, "a"), (4, "a"), (5, "x" * 100_000)], "doc_id long, text string").selectExpr("*", "1 as n_words")
    got = sorted(((r.doc_id, r.n_words) for r in wordpiece_counts(df, vocabulary=PATH).collect()), key=str)
    assert got == sorted([(1, 0), (2, 0), (3, 0), (None, 1), (4, 1), (4, 1), (5, 1)], key=str)
    assert wordpiece_counts(df.limit(0), vocabulary=PATH).count() == 0
