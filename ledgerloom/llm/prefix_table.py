"""Operator 2: SentencePiece merge-type encoding by a table of each prefix's last token, and decoding."""

from __future__ import annotations

import functools
import hashlib
import re

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from ledgerloom.llm.memo import Memo
from ledgerloom.llm.runtime import arrow_map, id_and_text

#: The model's mark for a space. Inside the codec spaces stand for themselves, and a mark in a text counts as one.
SPACE = "▁"
#: No piece has a space after another character, so merges never cross the end of one of these.
CHUNK = re.compile(" *[^ ]+| +")
#: Codes of characters that are no piece start here, above every id.
UNKNOWN = 1 << 24


class PrefixTableCodec:
    """Encoder and decoder for one model with byte fallback and an identity normaliser.

    The encoding of a prefix of a text ends in one token, whatever follows; the
    table holds it for every prefix. A token that ends at a position is the
    one if it starts the text, or if it is compatible with the last token of
    the prefix before it: merging the two tokens' characters gives back just
    the two. An Aho-Corasick automaton lists the tokens that end at each position, so the
    table takes one pass; the ids are read from its end backwards.
    """

    def __init__(self, model_path: str, memo: int = 400_000):
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i).replace(SPACE, " ") for i in range(n)]
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
            or model.is_unused(i) for i in range(n)]
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(n) if model.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.silent = {i for i in range(n) if model.is_control(i)}
        self.unk = model.unk_id()
        self.plain = frozenset(i for i in range(n) if not special[i])
        self.score = {self.pieces[i]: model.get_score(i) for i in range(n) if not special[i]}
        self.id_of = {self.pieces[i]: i for i in range(n) if not special[i]}
        if any(" " in p.lstrip(" ") for p in self.score):
            raise ValueError("pieces with an inner space mark are not supported")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            if self._merge(piece) == [piece]:  # others never occur in an encoding
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.alphabet = frozenset(p for p in self.id_of if len(p) == 1 and p in self.automaton)
        self.size, self.decimal = [len(p) for p in self.pieces], [str(i) for i in range(n)]
        self.compatible: dict[int, bool] = {}
        self.chunks = Memo(self._encode_chunk, memo)

    def _merge(self, text: str) -> list[str]:
        """Greedy merging by its definition: best score first, leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _name(self, code: int) -> str:
        return chr(code - UNKNOWN) if code >= UNKNOWN else self.pieces[code]

    def _pair(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.compatible.get(key)
        if known is None:
            a, b = self._name(left), self._name(right)
            known = self._merge(a + b) == [a, b]
            if len(self.compatible) >= 500_000:
                self.compatible.clear()
            self.compatible[key] = known
        return known

    def last_tokens(self, text: str) -> list[int]:
        """For each prefix, by the place of its last character, the code of the last token of its encoding."""
        last = [-1] * len(text)
        compatible, pair = self.compatible, self._pair
        unknown = [] if self.alphabet.issuperset(text) else [k for k, c in enumerate(text) if c not in self.alphabet]
        waiting = iter(unknown)
        hole = next(waiting, -1)
        for end, (token, size) in self.automaton.iter(text):
            while 0 <= hole < end:  # no token ended at an unknown character: it stands alone
                if last[hole] < 0:
                    last[hole] = UNKNOWN + ord(text[hole])
                hole = next(waiting, -1)
            if last[end] < 0:
                before = end - size
                if before < 0:
                    last[end] = token
                else:
                    before = last[before]
                    known = compatible.get(before << 32 | token)
                    if known if known is not None else pair(before, token):
                        last[end] = token
        for k in unknown:
            if last[k] < 0:
                last[k] = UNKNOWN + ord(text[k])
        return last

    def encode_span(self, text: str) -> list[int]:
        """Ids of a text of one or more chunks, read from the table's end backwards."""
        last, at, out = self.last_tokens(text), len(text) - 1, []
        while at >= 0:
            code = last[at]
            if code >= UNKNOWN:
                out.extend(self.byte_id[b] for b in reversed(chr(code - UNKNOWN).encode("utf-8")))
                at -= 1
            else:
                out.append(code)
                at -= self.size[code]
        out.reverse()
        return out

    def _encode_chunk(self, chunk: str) -> str | tuple[str, str]:
        """Decimal ids joined by commas; with what they decode to, where that is not the chunk itself."""
        ids = self.encode_span(chunk)
        listed, decoded = ",".join(map(self.decimal.__getitem__, ids)), self._join(ids)
        return listed if decoded == chunk else (listed, decoded)

    def _listed_and_decoded(self, text: str) -> tuple[str, str]:
        if not text:
            return "", ""
        chunks = CHUNK.findall(" " + text.replace(SPACE, " "))
        found = list(map(self.chunks.__getitem__, chunks))
        try:
            return ",".join(found), "".join(chunks)[1:]
        except TypeError:
            pairs = [(x, c) if isinstance(x, str) else x for x, c in zip(found, chunks, strict=True)]
            return ",".join([x for x, _ in pairs]), "".join([c for _, c in pairs]).removeprefix(" ")

    def encode(self, text: str) -> list[int]:
        listed = self._listed_and_decoded(text)[0]
        return [int(x) for x in listed.split(",")] if listed else []

    def _join(self, ids: list[int]) -> str:
        if self.plain.issuperset(ids):
            return "".join([self.pieces[i] for i in ids])
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i == self.unk:
                out.append(" \u2047 ")
            elif i is not None and i not in self.silent:
                out.append(self.pieces[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the one space that encoding puts in front is taken off."""
        return self._join(ids).removeprefix(" ")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and of the text decoded from them."""
        listed, decoded = self._listed_and_decoded(text)
        sha = hashlib.sha256
        return listed.count(",") + 1 if listed else 0, sha(listed.encode()).hexdigest(), sha(
            decoded.encode()).hexdigest()


@functools.lru_cache(maxsize=2)
def codec(model_path: str) -> PrefixTableCodec:
    """One codec per worker process."""
    return PrefixTableCodec(model_path)


def encode_decode(
    docs: DataFrame, *, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False,
    keep_text: bool = False,
) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns ``id_col``, ``n_tokens`` (long), ``ids_sha256`` (of decimal ids joined by commas),
    ``decoded_sha256`` (of the decoded text in UTF-8), and on demand ``ids``
    (array<int>) and ``decoded`` (string). There is one output row per input row and no shuffle.

    Defined cases: null and empty texts have no ids and decode to the empty
    text; very long texts are encoded whole, chunk by chunk; a null id stays null; repeated rows are encoded alike; other columns
    are ignored; an empty table gives no rows. Memory is bounded by one Arrow batch and two bounded memos.
    """

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(model_path)
        texts = [t or "" for t in batch.column("__text").to_pylist()]
        rows = [c.digest(t) for t in texts]
        columns = [batch.column("__id"), pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids or keep_text:
            ids = [c.encode(t) for t in texts]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            if keep_text:
                columns.append(pa.array([c.decode(x) for x in ids], pa.string()))
                names.append("decoded")
        return pa.RecordBatch.from_arrays(columns, names=names)

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["__id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    return arrow_map(rows, fn, schema).withColumnRenamed("doc_id", id_col)
