"""Operator 8: order-preserving packing of token streams into sequences by dynamic programming."""

from __future__ import annotations

import functools
import json
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ledgerloom.llm.runtime import id_and_text, ship

#: The byte-level pre-tokenisation pattern and the printable stand-ins of bytes, as in the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SENTENCE_ENDS = (b".", b"!", b"?", b"\n")
#: Tokens packed by one run of the dynamic program; a run's end is a cut, so a partition of any size needs bounded memory.
RUN_TOKENS = 1 << 20


def _byte_of_printable() -> dict[str, int]:
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteTokenizer:
    """Ids of a byte-level BPE vocabulary file, and which ids end a sentence.

    The file's ids are ordered by merge, so ranks are ids; special tokens in a text are matched as the
    file's own library does by default.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = _byte_of_printable()
        ranks = {bytes(to_byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {k: v for k, v in ranks.items() if v not in special.values()}
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.ends = np.zeros(max([*ranks.values(), *special.values()]) + 1, bool)
        for piece, i in ranks.items():
            self.ends[i] = piece.endswith(SENTENCE_ENDS)

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all") if text else np.empty(0, np.uint32)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def best_cuts(points: list[int], penalties: list[int], limit: int, per_sequence: int) -> list[int]:
    """The cheapest places to cut a token stream into windows of at most ``limit`` tokens.

    ``points`` are the places where a cut is allowed, ascending, from 0 to the
    stream's end, no two neighbours further apart than ``limit``; ``penalties`` is what a cut
    there costs. A window costs ``per_sequence`` plus its padding: ``limit`` less its length, or none at a
    power of two. The padding is linear in the window's start, so the best
    start of a padded window is the front of a monotone queue; the windows
    without padding are looked up by their start. Returns the places of the chosen cuts, 0 first.
    """
    index = {p: k for k, p in enumerate(points)}
    powers = [1 << k for k in range(limit.bit_length()) if 1 << k <= limit]
    cost, back = [0] * len(points), [0] * len(points)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + start, index), the cheapest first
    fixed = limit + per_sequence
    at = index.get
    for k in range(1, len(points)):
        p = points[k]
        low = p - limit
        while points[queue[0][1]] < low:
            queue.popleft()
        best, source = queue[0]
        best += fixed - p
        for size in powers:
            j = at(p - size)
            if j is not None and cost[j] + per_sequence < best:
                best, source = cost[j] + per_sequence, j
        best += penalties[k]
        cost[k], back[k] = best, source
        key = best + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, k))
    cuts, k = [points[-1]], len(points) - 1
    while k:
        k = back[k]
        cuts.append(points[k])
    return cuts[::-1]


def pack(
    ids: np.ndarray, ends: np.ndarray, sentence: np.ndarray, *, limit: int, sentence_penalty: int, hard_penalty: int,
    per_sequence: int, hard_step: int,
) -> list[tuple[int, int, int, int, int]]:
    """Pack one run of documents. ``ends``: where each ends in ``ids``; ``sentence``: which tokens end a sentence.

    Returns (document, start in it, length, sequence, offset) for each piece.
    """
    total = len(ids)
    if not total:
        return []
    kind = np.zeros(total + 1, np.int8)  # 1: a sentence ends here, 2: a document
    kind[1:][sentence] = 1
    kind[ends] = 2
    kind[0] = kind[total] = 2
    natural = np.flatnonzero(kind)
    # where sentences are long, also cuts within them, at a price
    gaps = np.diff(natural)
    wide = np.flatnonzero(gaps > hard_step)
    extra = [np.arange(natural[k] + hard_step, natural[k + 1], hard_step) for k in wide]
    points = np.unique(np.concatenate([natural, *extra])) if extra else natural
    price = np.where(kind[points] == 2, 0, np.where(kind[points] == 1, sentence_penalty, hard_penalty))
    cuts = best_cuts(points.tolist(), price.tolist(), limit, per_sequence)
    # pieces: the stream cut at both the documents' ends and the windows' ends
    edges = np.unique(np.concatenate([cuts, ends, [0]]))
    first, last = edges[:-1], edges[1:]
    doc = np.searchsorted(ends, first, side="right")
    seq = np.searchsorted(cuts, first, side="right") - 1
    doc_start = np.concatenate([[0], ends])[doc]
    return list(zip(doc.tolist(), (first - doc_start).tolist(), (last - first).tolist(), seq.tolist(),
        (first - np.asarray(cuts)[seq]).tolist(), strict=True))


def pack_documents(
    docs: DataFrame, *, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024,
    end_id: int = 0,
    sentence_penalty: int = 2, hard_penalty: int = 24, per_sequence: int = 8, hard_step: int = 64,
) -> DataFrame:
    """Pack every document's token ids, plus ``end_id``, into sequences of at most ``limit`` ids.

    Returns a row per piece: ``id_col``, ``start`` (ids of its document before it), ``length``,
    ``ids_crc32`` (of little-endian unsigned 32-bit ids), ``doc_tokens`` (with the end id),
    ``sequence_id``, ``offset`` (in the sequence, gapless from 0), all long, and ``ids`` is left out: texts and places restore them.

    Each partition is sorted by id and packed as one ordered stream, so nothing is shuffled. Cuts are
    free between documents, cost ``sentence_penalty`` after a sentence and ``hard_penalty`` within one (every
    ``hard_step`` ids of a long sentence); the dynamic program weighs
    them against padding. Sequence ids are the partition's number times 2**33 plus a
    count. A lost task packs the same rows in the same order again.

    Defined cases: null and empty texts are one piece with the end id alone; very long texts are cut like others, run by run; of cuts of equal
    cost the one with the shortest last window counts, and a padded window before one without padding; a
    null id stays null and packs like any other; repeated rows are packed each, as separate documents; other
    columns are ignored; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        base = TaskContext.get().partitionId() << 33
        names: list = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal base, held
            ids = np.concatenate(parts)
            sizes = np.array([len(p) for p in parts])
            ends = np.cumsum(sizes)
            pieces = pack(ids, ends, tok.ends[ids], limit=limit, sentence_penalty=sentence_penalty,
                hard_penalty=hard_penalty, per_sequence=per_sequence, hard_step=hard_step)
            raw, begin = ids.astype("<u4").tobytes(), ends - sizes
            doc = np.array([p[0] for p in pieces])
            cols = [np.array([p[k] for p in pieces], np.int64) for k in (1, 2, 3, 4)]
            first = begin[doc] + cols[0]
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), cols[1].tolist(), strict=True)]
            out = pa.RecordBatch.from_arrays(
                [pa.array([names[d] for d in doc], pa.int64()), pa.array(cols[0]), pa.array(cols[1]),
                    pa.array(crc, pa.int64()), pa.array(sizes[doc].astype(np.int64)), pa.array(cols[2] + base),
                    pa.array(cols[3])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            base += int(cols[2][-1]) + 1
            names.clear()
            parts.clear()
            held = 0
            return out

        end = np.array([end_id], np.uint32)
        for batch in batches:
            for i, text in zip(batch.column("__id").to_pylist(), batch.column("__text").to_pylist(), strict=True):
                names.append(i)
                parts.append(np.concatenate([tok.encode(text or ""), end]))
                held += len(parts[-1])
                if held >= RUN_TOKENS:
                    yield flush()
        if parts:
            yield flush()

    ship(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)
    rows = rows.withColumn("__id", rows["__id"].cast("bigint")).sortWithinPartitions("__id", "__text")
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return rows.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)
