"""Operator 2 against the sentencepiece library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm.prefix_table import codec, encode_decode

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" ▁ae\n\tthin.", max_size=40))
def test_any_text(text):
    ids = codec(PATH).encode(text)
    assert ids == LIB.encode(text)
    assert codec(PATH).decode(ids) == LIB.decode(ids)


def test_spaces_unknown_characters_and_long_words():
    rng = random.Random(3)
    cases = [" " * n + "word" + " " * n for n in range(40)] + ["ab" * 3000, "▁" * 70, "x" + "é" * 500, "<0x41> <s> <unk>", "𝒳𝒴 日本語\x00\r\n"]
    cases += ["".join(rng.choice("aeinth 123.,-_=") for _ in range(rng.randint(1, 300))) for _ in range(200)]
    for text in cases:
        ids = codec(PATH).encode(text)
        assert ids == LIB.encode(text), text
        assert codec(PATH).decode(ids) == LIB.decode(ids), text


def test_operator(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in encode_decode(docs, model_path=PATH, keep_ids=True, keep_text=True).collect()}
    for r in docs.collect():
        ids = LIB.encode(r.text)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert got[r.doc_id] == (len(ids), sha(",".join(map(str, ids))), sha(LIB.decode(ids)), ids, LIB.decode(ids))


def test_operator_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a", "y"), (3, "b", None), (3, "b", None)], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.n_tokens) for r in encode_decode(df, model_path=PATH).collect()), key=str)
    assert got == sorted([(1, 0), (2, 0), (None, 1), (3, 1), (3, 1)], key=str)
    assert encode_decode(df.limit(0), model_path=PATH).count() == 0
    with pytest.raises(Exception, match="missing"):
        encode_decode(df, model_path=PATH, text_col="missing")


def test_operator_on_a_very_long_text(spark):
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("aeinthso") for _ in range(rng.randrange(1, 12))) for _ in range(300_000))
    row = encode_decode(spark.createDataFrame([(1, text)], "doc_id long, text string"), model_path=PATH).first()
    ids = LIB.encode(text)
    assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()
