"""Operator 11: align the tokens of two vocabularies over the same bytes and weigh the links by the documents that hold them."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.packing import ByteTokenizer
from ledgerloom.llm.runtime import SLICE_BYTES, SLICE_ROWS, discard, id_and_text, materialize, ship

#: A pair of ids is one number: the first id above, the second in the lower bits.
SHIFT = 32


def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of each number up to ``most``, with a place for a separator behind, and how many bytes that is."""
    width = len(str(most)) + 1
    cells, sizes = np.zeros((most + 1, width), np.uint8), np.zeros(most + 1, np.int64)
    for i in range(most + 1):
        text = str(i).encode()
        cells[i, : len(text)] = np.frombuffer(text, np.uint8)
        sizes[i] = len(text) + 1
    return cells, sizes


class Alignment:
    """The links and groups of a batch of texts, of which the documents' byte offsets tell one from the next.

    ``n_a``, ``n_b``, ``n_groups`` and ``n_links`` have an entry per document. ``link_doc``, ``link_a`` and
    ``link_b`` have one per link, in order; ``groups`` is the text form of a document's groups.
    """

    def __init__(self, ids_a: list[np.ndarray], ids_b: list[np.ndarray], size_a: np.ndarray, size_b: np.ndarray, cells: np.ndarray, widths: np.ndarray):
        one = lambda ids: np.concatenate([np.empty(0, np.int64), *ids]).astype(np.int64)
        a, b = one(ids_a), one(ids_b)
        end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
        bytes_ = int(end_a[-1]) if len(a) else 0
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        cut_a, cut_b = (np.bincount(e, minlength=bytes_ + 1).astype(bool) for e in (end_a, end_b))
        # each end, of either side, closes the range that one token of a and one of b share: a link
        at = np.flatnonzero(cut_a | cut_b)
        before = lambda cut: np.cumsum(cut[at]) - cut[at]
        link_a, link_b = before(cut_a), before(cut_b)
        group = before(cut_a & cut_b)
        # prefix sums at the documents' last bytes
        doc_end = np.concatenate([[0], end_a])[np.cumsum(self.n_a)]
        links = np.searchsorted(at, doc_end, "right")
        groups = np.cumsum(np.concatenate([[0], (cut_a & cut_b)[at]]))[links]
        self.n_links, self.n_groups = np.diff(links, prepend=0), np.diff(groups, prepend=0)
        self.link_doc = np.repeat(np.arange(len(ids_a)), self.n_links)
        self.link_a, self.link_b = a[link_a], b[link_b]
        self.groups = self._texts(a, b, cut_a, cut_b, end_a, end_b, group, cells, widths)

    def _texts(self, a, b, cut_a, cut_b, end_a, end_b, group, cells, widths) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each document: all ids in one row of cells, those of a group's a before those of its b."""
        both = cut_a & cut_b
        closed = np.cumsum(both)
        # groups that end before a token ends; tokens of the other side that go before it
        of_a, of_b = (closed[e] - both[e] for e in (end_a, end_b))
        n = int(closed[-1]) if len(closed) else 0
        a_to, b_to = (np.cumsum(np.bincount(g, minlength=n)) for g in (of_a, of_b))
        place_a = np.arange(len(a)) + np.concatenate([[0], b_to])[of_a]
        place_b = np.arange(len(b)) + a_to[of_b] if n else np.arange(len(b))
        order, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        order[place_a], order[place_b] = a, b
        mark[place_a[a_to - 1]], mark[place_b[b_to - 1]] = ord("|"), ord(";")
        row, size = cells[order], widths[order]
        row[np.arange(len(order)), size - 1] = mark
        flat = row[np.arange(row.shape[1]) < size[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        return [flat[s : max(s, e - 1)] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class Aligner:
    """Both vocabularies: ids, and the bytes each id stands for."""

    def __init__(self, byte_vocabulary: str, piece_model: str):
        self.byte = ByteTokenizer(byte_vocabulary).encoding
        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        known = {self.byte.encode_single_token(x): x for x in self.byte.token_byte_values()}
        self.bytes_a = [known.get(i, b"") for i in range(self.byte.n_vocab)]
        p = self.piece
        self.bytes_b = [bytes([int(p.id_to_piece(i)[3:-1], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in range(p.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.cells, self.widths = _digits(max(len(self.bytes_a), len(self.bytes_b)))

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides, none where a side does not spell a space and the text."""
        none = np.empty(0, np.int32)
        if not text:
            return none, none
        want = b" " + text.encode()
        a, b = self.byte.encode_ordinary(" " + text), self.piece.encode(text)
        same = b"".join(map(self.bytes_a.__getitem__, a)) == want and b"".join(map(self.bytes_b.__getitem__, b)) == want
        return (np.array(a, np.int32), np.array(b, np.int32)) if same else (none, none)

    def align(self, texts: list[str | None]) -> Alignment:
        both = [self.ids(t) for t in texts]
        return Alignment([a for a, _ in both], [b for _, b in both], self.size_a, self.size_b, self.cells, self.widths)


@functools.lru_cache(maxsize=2)
def aligner(byte_vocabulary: str, piece_model: str) -> Aligner:
    return Aligner(byte_vocabulary, piece_model)


def _aligned(rows: DataFrame, byte_vocabulary: str, piece_model: str) -> DataFrame:
    """Documents and pairs of ids, block by block; a block is a slice of an Arrow batch.

    A document's row has its figures and, as bytes, which of its block's pairs it holds (numbers in ascending order of pairs)
    and how often. A pair's row has the number of the block's documents that hold it.
    """
    ship(rows.sparkSession)
    kind = rows.schema["__id"].dataType.simpleString()
    counts = ("n_a", "n_b", "n_groups", "n_links")
    names = ["block", "pair", "docs", "__id", *counts, "groups_sha256", "held", "times"]
    binary = lambda x, ends: pa.array([x[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)], pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(byte_vocabulary, piece_model)
        block = TaskContext.get().partitionId() << 40
        for batch in batches:
            step = max(1, min(SLICE_ROWS, SLICE_BYTES * batch.num_rows // max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                found = both.align(part.column("__text").to_pylist())
                n = part.num_rows
                pairs, number = np.unique(found.link_a << SHIFT | found.link_b, return_inverse=True)
                own, times = np.unique(found.link_doc * len(pairs) + number, return_counts=True)
                doc, number = (own // len(pairs), own % len(pairs)) if len(pairs) else (own, own)
                ends = np.searchsorted(doc, np.arange(n + 1)).tolist()
                sha = ["" if not k else hashlib.sha256(g).hexdigest() for g, k in zip(found.groups, found.n_links.tolist(), strict=True)]
                nothing = lambda t, k=n: pa.nulls(k, t)
                long = pa.int64()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), nothing(long), nothing(long), part.column("__id"), *(pa.array(getattr(found, c)) for c in counts), pa.array(sha, pa.string()),
                        binary(number.astype(np.int32), ends), binary(times.astype(np.int32), ends)], names=names)
                k = len(pairs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, block)), pa.array(pairs), pa.array(np.bincount(number, minlength=k)), nothing(part.schema.field("__id").type, k), *(nothing(long, k) for _ in counts),
                        nothing(pa.string(), k), nothing(pa.binary(), k), nothing(pa.binary(), k)], names=names)
                block += 1

    return rows.mapInArrow(run, f"block bigint, pair bigint, docs bigint, __id {kind}, {', '.join(f'{c} bigint' for c in counts)}, groups_sha256 string, held binary, times binary")


def align_tokenizers(docs: DataFrame, *, byte_vocabulary: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which tokens of two vocabularies share bytes of a text, and how many documents of the corpus link the same two ids.

    A: the text behind a space by the byte-level vocabulary, special tokens' strings being plain text. B: the text by the piece
    model, which adds the space. Where tokens of both end, a group ends.

    Returns ``id_col`` and, per row of ``docs``, ``n_a``, ``n_b``, ``n_groups``, ``n_links`` (pairs of tokens whose bytes overlap), ``n_best`` (links
    whose pair of ids is linked in as many documents as any pair of its A id), ``count_sum`` (the links' numbers of documents, added up) and
    ``groups_sha256`` (of ``a1,a2|b1;a3|b2,b3``).

    A slice of an Arrow batch is a block. Its documents' links are found at once, by counts of ends over the concatenated bytes and
    prefix sums; what leaves a block are its distinct pairs, so a frequent pair is one row a block, joined with its count by a join that
    adaptive execution may split. The counts come back to the blocks' documents in groups no larger than a block.

    Defined cases: a text that is null or empty, or that either side does not spell exactly, has zeros and an empty ``groups_sha256``;
    null ids stay, repeated rows are documents of their own; a text longer than a slice is a block of its own, read whole; other
    columns are ignored; no rows give no rows.
    """
    found = materialize(_aligned(id_and_text(docs, id_col, text_col), byte_vocabulary, piece_model), "aligned")
    pairs = found.where("pair is not null").select("block", "pair", "docs")
    counts = materialize(pairs.groupBy("pair").agg(F.sum("docs").alias("count")), "pair-counts")
    first = F.shiftright("pair", SHIFT)
    most = counts.groupBy(first.alias("a")).agg(F.max("count").alias("most"))
    weighed = counts.withColumn("a", first).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = pairs.select("block", "pair").join(materialize(weighed, "weighed-pairs"), "pair").select(F.col("block").alias("of_block"), "pair", "count", "best")
    discard(counts)
    rows = found.where("pair is null").drop("pair", "docs")
    names = ["__id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks().sort_by("pair")
        count, best = right.column("count").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        joined = lambda c: np.frombuffer(b"".join(left.column(c).to_pylist()), np.int32)
        held, times = joined("held"), joined("times").astype(np.int64)
        ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in left.column("held").to_pylist()])]).astype(np.int64)
        total = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[ends]).astype(np.int64))
        made = {"n_best": total(times * best[held]), "count_sum": total(times * count[held])}
        return pa.table([made[c] if c in made else left.column(c) for c in names], names=names)

    kind = rows.schema["__id"].dataType.simpleString()
    out = rows.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(fn, f"__id {kind}, {', '.join(f'{c} bigint' for c in names[1:-1])}, groups_sha256 string")
    return out.withColumnRenamed("__id", id_col)
