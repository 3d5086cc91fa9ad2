"""Tokenizer alignment against plain loops over token byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm.alignment import align_tokenizers
from ledgerloom.llm.packing import _byte_of_printable
from ledgerloom.llm.queries import op11_tokenizer_alignment
from tests.llm.test_dedup import DOCS

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def ranges(sizes):
    out, at = [], 0
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text, by both libraries and all pairs of ranges near each other."""
    byte = Tokenizer.from_file(BYTE)
    byte.encode_special_tokens = True
    piece = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    of_char = _byte_of_printable()
    spelled_a = {i: bytes(of_char[c] for c in t) for t, i in byte.get_vocab().items() if i < 50256}
    found = []
    for t in texts:
        links, groups = [], []
        a = byte.encode(" " + t, add_special_tokens=False).ids if t else []
        b = piece.encode(t) if t else []
        bytes_b = [bytes([int(piece.id_to_piece(i)[1:-1], 16)]) if piece.is_byte(i) else piece.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if t and b"".join(spelled_a[i] for i in a) == b"".join(bytes_b) == (" " + t).encode():
            ra, rb = ranges([len(spelled_a[i]) for i in a]), ranges([len(x) for x in bytes_b])
            first = 0
            for i, (s, e) in enumerate(ra):
                while rb[first][1] <= s:
                    first += 1
                j = first
                while j < len(rb) and rb[j][0] < e:
                    links.append((a[i], b[j]))
                    j += 1
            both = {e for _, e in ra} & {e for _, e in rb}
            ga, gb = [], []
            i = j = 0
            for end in sorted(both):
                while i < len(ra) and ra[i][1] <= end:
                    ga.append(str(a[i]))
                    i += 1
                while j < len(rb) and rb[j][1] <= end:
                    gb.append(str(b[j]))
                    j += 1
                groups.append(",".join(ga) + "|" + ",".join(gb))
                ga, gb = [], []
            found.append((len(a), len(b), links, groups))
        else:
            found.append((0, 0, links, groups))
    count = Counter(p for _, _, links, _ in found for p in set(links))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return [(na, nb, len(g), len(ls), sum(count[p] == most[p[0]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if ls else "")
        for na, nb, ls, g in found]


def run(spark, texts, **more):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"block": F.lit(1), "pair": F.lit("x"), "n_a": F.lit(None)}).repartition(3)
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in align_tokenizers(df, byte_vocabulary=BYTE, piece_model=PIECE, **more).collect()}
    return [got[i] for i in range(len(texts))]


def test_odd_texts(spark):
    rng = random.Random(5)
    chars = "abcdeABC  .,;\n\téüß€漢字🙂▁\x00<>|'0123"
    texts = [None, "", " ", "a", "hello world", "hello world", "<|endoftext|> and </s> <0x41>", "▁", "tab\tand\r\nline", "ﬁ ligature", "é", "é", "  two  spaces  ", " x"]
    texts += ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(120)]
    got = run(spark, texts)
    assert got == plain(texts)
    assert got[0] == got[1] == got[7] == (0, 0, 0, 0, 0, 0, "") and got[4][0] > 0


def test_documents_match_plain_loops(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(DOCS).collect()]
    want = dict(zip((i for i, _ in docs), plain([t for _, t in docs]), strict=True))
    assert {r.doc_id: tuple(r[f] for f in FIELDS) for r in op11_tokenizer_alignment(spark, DOCS.rpartition("/")[0]).collect()} == want


def test_long_text_repeated_and_null_ids(spark):
    rng = random.Random(6)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(200_000))
    df = spark.createDataFrame([("x", long), ("x", long), (None, "short text")], "name string, body string")
    got = sorted(((r.name or "", *(r[f] for f in FIELDS)) for r in align_tokenizers(df, byte_vocabulary=BYTE, piece_model=PIECE, id_col="name", text_col="body").collect()))
    want = plain([long, long, "short text"])
    assert got == sorted([("x", *want[0]), ("x", *want[1]), ("", *want[2])])


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert align_tokenizers(df, byte_vocabulary=BYTE, piece_model=PIECE).collect() == []
