"""Operator 13: remove every byte covered by a string of fixed length that also starts elsewhere in the corpus, by suffix order."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from ledgerloom.llm.hashing import _STEP, mix
from ledgerloom.llm.passages import _sliding, sieve, sifted
from ledgerloom.llm.runtime import arrow_map, discard, materialize, utf8_bytes

#: Bytes of a print, and of a symbol of the suffix order.
PRINT, SYMBOL = 16, 8
#: Bytes that are scanned at once; a longer text goes in pieces.
CHUNK = 1 << 19
#: Excerpts sorted together, and how many of one print at most; more are dealt over several blocks.
BLOCK, SHARE = 4096, 1024
_PLACE = np.uint64((1 << 24) - 1)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random number per byte value, and an odd multiplier per doubling of a print."""
    return mix(np.arange(1, 257, dtype=np.uint64) * _STEP), mix(np.arange(301, 310, dtype=np.uint64) * _STEP) | np.uint64(1)


def print_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each ``PRINT`` bytes."""
    values, factors = _tables()
    h, width, k = values[data], 1, 0
    while width < PRINT:
        h = h[:-width] * factors[k] + h[width:]
        width, k = 2 * width, k + 1
    return mix(h)


def excerpts_of(pieces: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """(piece, start, windows, anchor, print, digest) of the excerpts of ``pieces``.

    Of each window of ``width`` bytes the print of smallest hash is its anchor, the first of equal ones; which one depends on the
    window's bytes alone, so equal windows have their anchor at one place. Neighbouring windows of one anchor form an
    excerpt, from the first one's first byte to the last one's last; ``anchor`` is the anchor's offset in it.
    """
    text = b"".join(pieces)
    data = np.frombuffer(text, np.uint8)
    if len(data) < width:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64), np.empty(0, np.uint64))
    h = print_hashes(data)
    ranked = h & ~_PLACE | np.arange(len(h), dtype=np.uint64)
    at = (_sliding(ranked, width - PRINT + 1, np.minimum) & _PLACE).astype(np.int64)
    size = np.array([len(p) for p in pieces], np.int64)
    begin = np.cumsum(size) - size
    whole = np.zeros(len(at) + 1, np.int64)
    long = size >= width
    np.add.at(whole, begin[long], 1)
    np.add.at(whole, (begin + size - width + 1)[long], -1)
    valid = np.cumsum(whole[:-1]) > 0
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    windows = np.diff(np.cumsum(valid)[np.append(first[1:] - 1, len(valid) - 1)], prepend=0)
    piece = np.searchsorted(begin, first, "right") - 1
    digest = np.fromiter((xxh3_64_intdigest(text[s:e]) for s, e in zip(first.tolist(), (first + windows + width - 1).tolist(), strict=True)), np.uint64, len(first))
    return piece, first - begin[piece], windows, at[first] - first, h[at[first]], digest


def _pieces(texts: list[bytes | None], width: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(row, offset, bytes) of all texts with a window, in chunks; the pieces of a long text overlap by all but one byte of a window."""
    row, offset, piece, held = [], [], [], 0
    for k, t in enumerate(texts):
        for s in range(0, len(t or b"") - width + 1, CHUNK):
            row.append(k)
            offset.append(s)
            piece.append(t[s : s + CHUNK + width - 1])
            held += len(piece[-1])
            if held >= CHUNK:
                yield row, offset, piece
                row, offset, piece, held = [], [], [], 0
    if piece:
        yield row, offset, piece


def excerpts(docs: DataFrame, width: int) -> DataFrame:
    """(k1, k2, print, digest, start, windows, anchor) of all excerpts; k1 and k2 tell texts apart."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [[np.empty(0, np.int64)] for _ in range(6)]
        for row, offset, piece in _pieces(utf8_bytes(batch.column("__text")), width):
            at, start, windows, anchor, prints, digest = excerpts_of(piece, width)
            for part, x in zip(parts, (np.array(row)[at], np.array(offset)[at] + start, windows, anchor, prints.view(np.int64), digest.view(np.int64)), strict=True):
                part.append(x)
        row, start, windows, anchor, prints, digest = (np.concatenate(p) for p in parts)
        pick = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [batch.column("k1").take(pick), batch.column("k2").take(pick), pa.array(prints), pa.array(digest), *(pa.array(x.astype(np.int32)) for x in (start, windows, anchor))],
            names=["k1", "k2", "print", "digest", "start", "windows", "anchor"])

    return arrow_map(docs, fn, "k1 bigint, k2 bigint, print bigint, digest bigint, start int, windows int, anchor int")


class Compared:
    """Windows of excerpts, and which of them are equal.

    ``repeated`` tells per window whether its equal starts elsewhere in the excerpts, ``again`` whether it is such an equal but not the
    first in order. An excerpt is written as big-endian numbers of ``SYMBOL`` bytes on a grid through its anchor. Equal windows lie on the
    grid alike: ``before`` bytes, then whole symbols from place ``grid`` on, then the rest of one more symbol. ``order`` sorts the suffixes of the
    symbols; neighbours that agree in the whole symbols form a class, in which windows are told apart by the bytes at both ends.
    """

    def __init__(self, pieces: list[bytes], anchors: list[int], windows: list[int], width: int, order):
        self.inner = inner = width // SYMBOL - 1
        lead = np.array([-a % SYMBOL for a in anchors], np.int64)
        padded = [b"\0" * x + p + b"\0" * (-(x + len(p)) % SYMBOL) for x, p in zip(lead.tolist(), pieces, strict=True)]
        size = np.array([len(p) // SYMBOL + 1 for p in padded], np.int64)  # and a mark at the end
        numbers = np.zeros(int(size.sum()) + 1, np.uint64)
        inside = np.ones(len(numbers), bool)
        ends = np.cumsum(size)
        inside[ends - 1] = inside[-1] = False
        numbers[inside] = np.frombuffer(b"".join(padded), ">u8")
        symbols = np.ones(len(numbers), np.int64)
        symbols[inside] = np.unique(numbers[inside], return_inverse=True)[1] + 2
        symbols[-1] = 0
        many = np.array(windows, np.int64)
        base = np.cumsum(many) - many
        self.owner = owner = np.repeat(np.arange(len(pieces)), many)
        byte = lead[owner] + np.arange(len(owner)) - base[owner]
        self.numbers, self.first_place = numbers, ends - size
        self.grid, self.before = self.first_place[owner] - (-byte // SYMBOL), -byte % SYMBOL
        #: where in its excerpt a window with no bytes before the grid would start
        self.origin = SYMBOL * -(-byte // SYMBOL) - lead[owner]
        kind = self._classes(symbols, np.array(order(symbols.tolist()), np.int64))
        self.repeated, self.again = np.zeros(len(owner), bool), np.zeros(len(owner), bool)
        self._tell_apart(kind)

    def _classes(self, symbols: np.ndarray, ranked: np.ndarray) -> np.ndarray:
        """Of each place where windows have their first whole symbol a number that equal whole symbols share."""
        used = np.zeros(len(symbols), bool)
        used[self.grid] = True
        ranked = ranked[used[ranked]]
        left, right = ranked[:-1], ranked[1:]
        same = np.arange(len(left))
        for k in range(self.inner):
            same = same[symbols[left[same] + k] == symbols[right[same] + k]]
        joined = np.zeros(len(ranked), bool)
        joined[same + 1] = True
        kind = np.empty(len(symbols), np.int64)
        kind[ranked] = np.cumsum(~joined)
        self.shared = np.bincount(kind[ranked], minlength=len(ranked) + 1) > 1
        return kind

    def _tell_apart(self, kind: np.ndarray) -> None:
        open_ = np.flatnonzero(self.shared[kind[self.grid]])
        for r in range(SYMBOL):
            some = open_[self.before[open_] == r]
            at, bits = self.grid[some], np.uint64(8 * r)
            rest = self.numbers[at + self.inner] >> bits
            if r:
                rest = rest | self.numbers[at - 1] << np.uint64(64 - 8 * r)
            sort = np.lexsort((rest, kind[at]))
            some, rest, of = some[sort], rest[sort], kind[at][sort]
            equal = np.flatnonzero((rest[1:] == rest[:-1]) & (of[1:] == of[:-1]))
            self.repeated[some[equal]] = self.repeated[some[equal + 1]] = True
            self.again[some[equal + 1]] = True

    def open_places(self, dealt: np.ndarray, once: np.ndarray) -> Iterator[tuple]:
        """(excerpt, origin, digest, left, right, here, single) of each place of ``dealt`` excerpts: its whole symbols' digest, the numbers at both ends, and as bits
        by ``before`` which windows other blocks may hold and which of them have no equal yet."""
        some = np.flatnonzero(dealt[self.owner] & ~self.again)
        if not len(some):
            return
        first = np.flatnonzero(np.concatenate([[True], np.diff(self.grid[some]) != 0]))
        bit = np.int64(1) << self.before[some]
        here = np.bitwise_or.reduceat(bit, first)
        single = np.bitwise_or.reduceat(np.where(once[self.owner[some]] & ~self.repeated[some], bit, 0), first)
        text, signed = self.numbers.astype(">u8").tobytes(), self.numbers.view(np.int64)
        some = some[first]
        at = self.grid[some]
        left = np.where(at > 0, signed[at - 1], 0)
        for o, g, s, x, y, h, n in zip(self.owner[some].tolist(), at.tolist(), self.origin[some].tolist(), left.tolist(), signed[at + self.inner].tolist(), here.tolist(), single.tolist(), strict=True):
            yield o, s, xxh3_128_digest(text[SYMBOL * g : SYMBOL * (g + self.inner)]), x, y, h, n


def _runs(flags: np.ndarray, windows: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(excerpt, first, number) of each run of set flags, none across two excerpts."""
    ends = np.cumsum(windows)
    edge = np.zeros(len(flags) + 1, bool)
    edge[ends] = edge[0] = True
    start = np.flatnonzero(flags & (edge[:-1] | ~np.concatenate([[False], flags[:-1]])))
    stop = np.flatnonzero(flags & (edge[1:] | ~np.concatenate([flags[1:], [False]]))) + 1
    owner = np.searchsorted(ends, start, "right")
    return owner.tolist(), (start - (ends - np.array(windows))[owner]).tolist(), (stop - start).tolist()


def _compare(width: int):
    """A block's excerpts: rows of kind 0 are runs of windows that are repeated, rows of kind 1 places whose windows other blocks may hold."""

    def fn(table: pa.Table) -> pa.Table:
        from ledgerloom.llm.suffix_order import suffix_order

        rows = {c: table.column(c).to_pylist() for c in ("piece", "anchor", "windows", "once", "dealt", "start", "k1", "k2")}
        found = Compared(rows["piece"], rows["anchor"], rows["windows"], width, suffix_order)
        once, dealt = np.array(rows["once"], bool), np.array(rows["dealt"], bool)
        out: list[tuple] = [(0, rows["k1"][o], rows["k2"][o], rows["start"][o] + f, n, *[None] * 6)
            for o, f, n in zip(*_runs(found.repeated, rows["windows"]), strict=True) if once[o]]
        for o, s, d, left, right, here, single in found.open_places(dealt, once):
            hi, lo = (int.from_bytes(d[k : k + 8], "big", signed=True) for k in (0, 8))
            out.append((1, rows["k1"][o], rows["k2"][o], rows["start"][o] + s, 1, hi, lo, left, right, here, single))
        return pa.Table.from_pylist([dict(zip(SCHEMA.names, r, strict=True)) for r in out], SCHEMA)

    return fn


SCHEMA = pa.schema([("kind", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()),
    ("left", pa.int64()), ("right", pa.int64()), ("here", pa.int32()), ("single", pa.int32())])


def _across(places: DataFrame) -> DataFrame:
    """(k1, k2, start, windows): single windows of one block whose equal is in another, from rows of kind 1."""
    met = places.groupBy("hi", "lo").agg(F.count("*").alias("times")).where("times > 1").select("hi", "lo")
    near = places.join(materialize(met, "met-places"), ["hi", "lo"])
    r = F.col("r")
    shift = lambda name, x, by: F.call_function(name, x, by.cast("int"))
    has = lambda bits: shift("shiftright", bits, r).bitwiseAND(1) == 1
    rest = F.when(r == 0, F.col("right")).otherwise(shift("shiftleft", F.col("left"), 64 - 8 * r).bitwiseOR(shift("shiftrightunsigned", F.col("right"), 8 * r)))
    each = near.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(SYMBOL - 1)))).where(has(F.col("here")))
    each = each.select("hi", "lo", "r", rest.alias("rest"), "k1", "k2", (F.col("start") - r).alias("start"), "windows", has(F.col("single")).alias("single"))
    keys = ["hi", "lo", "r", "rest"]
    twice = each.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1").select(*keys)
    return each.where("single").join(materialize(twice, "met-windows"), keys).select("k1", "k2", "start", "windows")


def _cut_out(docs: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """The bytes of the ``asked`` excerpts, from one row of each text."""
    by_text = materialize(asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("print", "start", "windows", "anchor", "once", "dealt", "block")).alias("parts")), "wanted")
    name = F.xxhash64("k1", "k2")
    some = sifted(docs, name, sieve(by_text, name)).where("__maybe").drop("__maybe")
    texts = some.groupBy("k1", "k2").agg(F.any_value("__text").alias("__text"))
    kinds = {"block": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "start": pa.int32(), "windows": pa.int32(), "anchor": pa.int32(), "once": pa.bool_(), "dealt": pa.bool_(),
        "piece": pa.binary()}

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {c: [] for c in kinds}
        for k1, k2, t, parts in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2")), utf8_bytes(batch.column("__text")), batch.column("parts").to_pylist(), strict=True):
            for p in parts:
                out["k1"].append(k1)
                out["k2"].append(k2)
                out["piece"].append(t[p["start"] : p["start"] + p["windows"] + width - 1])
                for c in ("block", "start", "windows", "anchor", "once", "dealt"):
                    out[c].append(p[c])
        return pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in kinds.items()], names=list(kinds))

    return arrow_map(texts.join(by_text, ["k1", "k2"]), fn, "block bigint, k1 bigint, k2 bigint, start int, windows int, anchor int, once boolean, dealt boolean, piece binary")


def repeated_ranges(docs: DataFrame, width: int) -> DataFrame:
    """(k1, k2, start, windows): runs of windows of the texts in ``docs`` (k1, k2, __text) that also start elsewhere."""
    every = materialize(excerpts(docs, width), "excerpts")
    twice = materialize(every.groupBy("print").agg(F.count("*").alias("times")).where("times > 1").select("print"), "repeated-prints")
    near = sifted(every, F.col("print"), sieve(twice, F.col("print"))).where("__maybe").drop("__maybe").join(twice, "print")
    near = materialize(near, "near-excerpts")
    discard(every)
    discard(twice)
    c = F.col
    place = F.min(F.struct("k1", "k2", "start", "windows", "anchor")).alias("first")
    classes = materialize(near.groupBy("print", "digest").agg(F.count("*").alias("times"), place).select("print", "digest", "times", "first.*"), "excerpt-classes")
    whole = near.join(classes.where("times > 1").select("print", "digest"), ["print", "digest"]).select("k1", "k2", "start", "windows")
    several = classes.groupBy("print").agg(F.count("*").alias("kinds")).where("kinds > 1")
    asked = materialize(classes.join(several, "print"), "asked-excerpts")
    blocks = asked.count() // BLOCK + 1
    shares = F.ceil(c("kinds") / SHARE)
    salt = F.when(shares > 1, F.pmod(F.xxhash64("digest"), shares)).otherwise(F.lit(0))
    dealt = asked.withColumns({"once": c("times") == 1, "dealt": shares > 1, "block": F.pmod(F.xxhash64("print", salt), F.lit(blocks))})
    names = ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'bigint'}" for f in SCHEMA)
    found = materialize(_cut_out(docs, dealt, width).groupBy("block").applyInArrow(_compare(width), names), "compared")
    runs = found.where("kind = 0").select("k1", "k2", "start", "windows")
    return whole.union(runs).union(_across(found.where("kind = 1")))


def remove_repeated_strings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 200) -> DataFrame:
    """Remove each byte that a string of ``width`` bytes covers which also starts anywhere else in the corpus.

    Texts are UTF-8 bytes, strings never cross texts, those of one text count as well, overlapping or not; all occurrences go, and
    what is repeated is judged on the input. Returns ``id_col``, ``n_bytes``, ``n_removed``, ``n_spans`` (long), ``removed`` (the maximal removed runs as
    ``array<struct<start, end>>`` of byte offsets) and ``kept`` (binary: what is left, joined; it may split a character).

    Equal strings share the print that anchors them, so they meet as excerpts of one anchor. Excerpts that are equal as a whole are
    counted and go no further than one of them; of anchors with different excerpts, one of each kind is cut out and sorted,
    block by block, by the suffix order of its symbols. An anchor with very many kinds is dealt over several blocks;
    strings that such a block leaves single meet those of the other blocks, as do one of each that it finds repeated: first by a digest of
    the whole symbols that eight neighbouring strings share, then, where two blocks have that, one by one. No
    step holds more than a block of excerpts, no pairs are formed, and nothing but a number of rows reaches the driver.

    Defined cases: null and empty texts have 0 bytes and lose nothing, and so do texts shorter than ``width``; null ids stay; repeated rows are
    copies of each other; texts longer than a chunk are scanned in overlapping pieces, without loss; equal strings that overlap go, too (a long run of one
    character is removed); other columns are ignored whatever their names; no rows give no rows. ``width`` is a multiple of 8 from 32 on.
    """
    if width % SYMBOL or width < 2 * PRINT:
        raise ValueError(f"width is a multiple of {SYMBOL} from {2 * PRINT} on")
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), text.alias("__text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    long = rows.where(F.octet_length("__text") >= width).select("k1", "k2", "__text")
    # copies of a text have the same runs, of which one each is collected
    ranges = repeated_ranges(long, width).distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "windows")).alias("__ranges"))
    ranges = materialize(ranges, "ranges")
    name = F.xxhash64("k1", "k2")
    split = sifted(rows, name, sieve(ranges, name))
    both = split.where("__maybe").join(ranges, ["k1", "k2"], "left").select("__id", "__text", "__ranges")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, gone, removed, kept = [], [], [], []
        for t, found in zip(utf8_bytes(batch.column("__text")), batch.column("__ranges").to_pylist(), strict=True):
            t = t or b""
            spans: list[dict[str, int]] = []
            for start, stop in sorted((r["start"], r["start"] + r["windows"] + width - 1) for r in found or ()):
                if spans and start <= spans[-1]["end"]:
                    spans[-1]["end"] = max(stop, spans[-1]["end"])
                else:
                    spans.append({"start": start, "end": stop})
            size.append(len(t))
            gone.append(sum(s["end"] - s["start"] for s in spans))
            edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(t)]
            kept.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            removed.append(spans)
        long_, span = pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(size, long_), pa.array(gone, long_), pa.array([len(x) for x in removed], long_), pa.array(removed, span),
            pa.array(kept, pa.binary())], names=["__id", "n_bytes", "n_removed", "n_spans", "removed", "kept"])

    kind = rows.schema["__id"].dataType.simpleString()
    out = arrow_map(both, fn, f"__id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, removed array<struct<start:int,end:int>>, kept binary")
    none, size = F.lit(0).cast("bigint"), F.coalesce(F.octet_length("__text"), F.lit(0)).cast("bigint")
    spans = F.array().cast("array<struct<start:int,end:int>>")
    out = out.union(split.where("not __maybe").select("__id", size, none, none, spans, F.coalesce(F.col("__text"), F.lit("")).cast("binary")))
    return out.withColumnRenamed("__id", id_col)
