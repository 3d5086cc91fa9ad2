"""Passages: runs of words that occur earlier in the corpus, wherever in a line they stand."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from ledgerloom.llm.hashing import _STEP, mix, word_hashes
from ledgerloom.llm.runtime import arrow_map, discard, materialize

#: Words of a fingerprint.
PRINT = 20
#: 64-bit words of a sieve; its size does not grow with the table.
SIEVE = 1 << 17
_PLACE = np.uint64((1 << 24) - 1)
_WORD, _BLANK = re.compile(r"\S+"), re.compile(r"[^\S\n]*")


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, put together from runs of powers of two."""
    out, power, width, have = None, h, 1, 0
    while True:
        if size & width:
            out = power if out is None else mix(out[: len(h) - have - width + 1]) * _STEP + power[
                have : len(h) - width + 1]
            have += width
        if have == size:
            return out
        power = mix(power[: len(power) - width]) * _STEP + power[width:]
        width *= 2


def _sliding(x: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """Minimum or maximum of each ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = least(x[: len(x) - step], x[step:])
        have += step
    return x


def hashes_of(text: str) -> np.ndarray:
    """A hash of each lower-cased word."""
    words = " ".join(text.lower().split()).encode("utf-8", "surrogatepass")
    return word_hashes(words.split(b" ") if words else [])


def open_windows(text: str, spans: list[dict] | None, windows: int, words: int) -> np.ndarray:
    """Which windows of ``words`` words do not lie within one of the spans, which are cut already."""
    step, at, place = np.zeros(windows + 1, np.int64), 0, 0
    for s in sorted(spans or [], key=lambda s: (s["start"], -s["end"])):
        if s["start"] < at:  # within the span before
            continue
        first = place + len(text[at : s["start"]].split())
        place, at = first + len(text[s["start"] : s["end"]].split()), s["end"]
        if place - first >= words:
            step[first] += 1
            step[place - words + 1] -= 1
    return np.cumsum(step[:-1]) == 0


def smallest_prints(h: np.ndarray, words: int) -> np.ndarray:
    """Of each window of ``words`` words the smallest hash of ``PRINT`` words; equal windows have an equal one."""
    return _sliding(mix(run_hashes(h, PRINT)), words - PRINT + 1, np.minimum)


def fingerprints(h: np.ndarray, words: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The smallest prints of the ``wanted`` windows (all), one for each place that has one."""
    if len(h) < words:
        return np.empty(0, np.uint64)
    prints, low, width = mix(run_hashes(h, PRINT)), smallest_prints(h, words), words - PRINT + 1
    if wanted is not None:
        low = np.where(wanted, low, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    return prints[prints == _sliding(np.concatenate([pad, low, pad]), width, np.maximum)]


def excerpts_of(h: np.ndarray, words: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, number, print) of each run of ``wanted`` windows that have one smallest print at one place.

    Equal windows have theirs at an equal place, so texts that share a passage mostly share whole runs of it.
    """
    place = np.arange(len(h) - PRINT + 1, dtype=np.uint64) & _PLACE
    prints = mix(run_hashes(h, PRINT))
    at = (_sliding(prints & ~_PLACE | place, words - PRINT + 1, np.minimum) & _PLACE).astype(np.int64)
    new = wanted.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~wanted[:-1]
    first = np.flatnonzero(new)
    number = np.diff(np.append(np.cumsum(wanted)[first] - 1, wanted.sum()))
    # a print's place is known up to 2 ** 24 words, which is further than a window reaches
    own = first + (at[first] - first) % (int(_PLACE) + 1)
    return first, number, prints[own]


def spans_of(text: str, places: list[tuple[int, int]], words: int, spans: list[dict] | None) -> list[dict]:
    """Character spans of runs of windows (first, number), and ``spans``; those that overlap are one.

    A span that ends within a line takes the blanks up to the next word with it.
    """
    found = [(s["start"], s["end"]) for s in spans or []]
    if places:
        at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        gone = np.zeros(len(at) + 2, np.int64)
        first, number = np.array(places).T
        np.add.at(gone, first + 1, 1)
        np.add.at(gone, first + number + words, -1)
        edges = np.flatnonzero(np.diff((np.cumsum(gone) > 0).astype(np.int8)))
        for first, after in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            end = at[after - 1][1]
            blank = _BLANK.match(text, end).end()
            found.append((at[first][0], blank if blank < len(text) and text[blank] != "\n" else end))
    joined: list[dict] = []
    for start, end in sorted(found):
        if joined and start < joined[-1]["end"]:
            joined[-1]["end"] = max(joined[-1]["end"], end)
        else:
            joined.append({"start": start, "end": end})
    return joined


def sieve(hashes: DataFrame, column: Column) -> DataFrame:
    """(slot, bits): a bit set for each hash, at most ``SIEVE`` rows. It only keeps rows out of a join that they cannot meet in."""
    return hashes.groupBy(F.pmod(column, F.lit(SIEVE)).alias("__slot")).agg(F.bit_or(_bit(column)).alias("__bits"))


def _bit(column: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"),
        F.pmod(F.shiftrightunsigned(column, 20), F.lit(64)).cast("int"))


def sifted(df: DataFrame, column: Column, bits: DataFrame) -> DataFrame:
    """``df`` with ``__maybe``: false where the sieve shows that ``column`` is not among its hashes."""
    both = df.withColumn("__slot", F.pmod(column, F.lit(SIEVE))).join(F.broadcast(bits), "__slot", "left")
    return both.withColumn("__maybe",
        F.coalesce(F.col("__bits").bitwiseAND(_bit(column)) != 0, F.lit(False))).drop("__slot", "__bits")


def add_repeated_passages(rows: DataFrame, text_col: str, words: int) -> DataFrame:
    """``rows`` (``__id``, ``__key``, the text and ``__spans``, units that are cut) with the repeated runs of ``words`` words or more in ``__spans``.

    Runs are of lower-cased words of the whole text, line ends or not. A window of ``words`` words whose equal stands
    earlier, in the rank of (id, key, place), is cut; overlapping ones make the longer run. Windows within a cut unit have their
    equal in the unit's first occurrence, so they are neither looked up nor ever the first. Equal windows share their smallest
    print, so only windows whose print occurs twice are looked up, which leaves none out. Neighbouring windows of one print are an excerpt. All
    but the first of equal excerpts are cut as a whole, a row each; the first ones of different excerpts of a print are compared
    window by window (128 bits). Hot excerpts and windows are reduced to their first place before the shuffle; no pairs of texts are formed.
    """
    if words < 2 * PRINT:
        raise ValueError(f"passages have {2 * PRINT} words or more")
    id_type = rows.schema["__id"].dataType.simpleString()
    text = rows.select("__id", "__key", F.col(f"`{text_col}`").alias("__text"), "__spans")

    def prints(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, value = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for k, (t, spans) in enumerate(
            zip(batch.column("__text").to_pylist(), batch.column("__spans").to_pylist(), strict=True)):
            if t and not any(s["start"] == 0 and s["end"] == len(t) for s in spans or ()):
                h = hashes_of(t)
                if len(h) >= words:
                    v = fingerprints(h, words, open_windows(t, spans, len(h) - words + 1, words) if spans else None)
                    row.append(np.full(len(v), k))
                    value.append(v)
        pick = pa.array(np.concatenate(row))
        return pa.RecordBatch.from_arrays(
            [batch.column("__id").take(pick), batch.column("__key").take(pick),
                pa.array(np.concatenate(value).view(np.int64))], names=["__id", "__key", "print"])

    found = materialize(arrow_map(text, prints, f"__id {id_type}, __key bigint, print bigint"), "prints")
    twice = materialize(found.groupBy("print").agg(F.count("*").alias("times")).where("times > 1").select("print"),
        "repeated-prints")
    near = sifted(found, F.col("print"), sieve(twice, F.col("print"))).where("__maybe").drop("__maybe")
    marks = materialize(near.join(twice, "print").groupBy("__id", "__key")
        .agg(F.collect_set("print").alias("__prints")), "marks")

    discard(found)
    discard(twice)

    name = F.xxhash64("__id", "__key")
    split = sifted(rows, name, sieve(marks, name))
    some = materialize(split.where("__maybe").drop("__maybe").join(marks, ["__id", "__key"], "left"), "candidates")

    def marked(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, parts = [np.empty(0, np.int64)], [[np.empty(0, np.int64)] for _ in range(3)]
        digest: list[bytes] = []
        columns = (batch.column(c).to_pylist() for c in ("__text", "__spans", "__prints"))
        for k, (t, spans, prints_) in enumerate(zip(*columns, strict=True)):
            h = hashes_of(t)
            wanted = np.isin(smallest_prints(h, words), np.array(prints_, np.int64).view(np.uint64))
            first, number, own = excerpts_of(h, words, wanted & open_windows(t, spans, len(wanted), words))
            row.append(np.full(len(first), k))
            digest += [xxh3_128_digest(h[a : a + n + words - 1].tobytes()) for a, n in zip(first.tolist(), number.tolist(), strict=True)]
            for part, x in zip(parts, (first, number, own.view(np.int64)), strict=True):
                part.append(x)
        pick = pa.array(np.concatenate(row))
        place, windows, own = (np.concatenate(x) for x in parts)
        two = np.frombuffer(b"".join(digest), ">i8").astype(np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [batch.column("__id").take(pick), batch.column("__key").take(pick), pa.array(place, pa.int32()), pa.array(windows, pa.int32()), pa.array(own),
                pa.array(two[:, 0]), pa.array(two[:, 1])], names=["__id", "__key", "place", "windows", "print", "hi", "lo"])

    asked = some.where("__prints is not null").select("__id", "__key", F.col(f"`{text_col}`").alias("__text"),
        "__spans", "__prints")
    excerpts = materialize(arrow_map(asked, marked, f"__id {id_type}, __key bigint, place int, windows int, print bigint, hi bigint, lo bigint"), "excerpts")
    place = F.struct("__id", "__key", "place")
    classes = excerpts.groupBy("hi", "lo").agg(F.min(F.struct("__id", "__key", "place", "windows", "print")).alias("first"), F.count("*").alias("times"))
    classes = materialize(classes.select("hi", "lo", "first", "times"), "excerpt-classes")
    copies = excerpts.join(classes.where("times > 1"), ["hi", "lo"]).where(place != F.struct(*(F.col("first")[c] for c in ("__id", "__key", "place"))))
    several = classes.groupBy("first.print").agg(F.count("*").alias("kinds")).where("kinds > 1").select("print")
    single = classes.select("first.*").join(several, "print")
    single = single.groupBy("__id", "__key").agg(F.collect_list(F.struct("place", "windows")).alias("__runs"))

    def windows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, parts = [np.empty(0, np.int64)], [[np.empty(0, np.int64)] for _ in range(3)]
        for k, (t, found) in enumerate(zip(batch.column("__text").to_pylist(), batch.column("__runs").to_pylist(), strict=True)):
            h = hashes_of(t)
            at = np.concatenate([np.arange(r["place"], r["place"] + r["windows"]) for r in found])
            row.append(np.full(len(at), k))
            for part, x in zip(parts, (at, *(mix(run_hashes(x, words))[at].view(np.int64) for x in (h, mix(h + _STEP)))), strict=True):
                part.append(x)
        pick = pa.array(np.concatenate(row))
        place, hi, lo = (np.concatenate(x) for x in parts)
        return pa.RecordBatch.from_arrays(
            [batch.column("__id").take(pick), batch.column("__key").take(pick), pa.array(place, pa.int32()),
                pa.array(hi), pa.array(lo)], names=["__id", "__key", "place", "hi", "lo"])

    every = arrow_map(asked.drop("__spans", "__prints").join(single, ["__id", "__key"]), windows_of, f"__id {id_type}, __key bigint, place int, hi bigint, lo bigint")
    every = materialize(every, "windows")
    first = every.groupBy("hi", "lo").agg(F.min(place).alias("first"),
        F.count("*").alias("times")).where("times > 1").select("hi", "lo", "first")
    first = materialize(first, "repeated-windows")
    later = every.join(first, ["hi", "lo"]).where(place != F.col("first")).select("__id", "__key", "place", F.lit(1).alias("windows"))
    later = copies.select("__id", "__key", "place", "windows").union(later)
    later = materialize(later.groupBy("__id", "__key").agg(F.collect_set(F.struct("place", "windows")).alias("__places")), "cut-windows")
    for table in (excerpts, classes, every, first):
        discard(table)
    both = some.drop("__prints").join(later, ["__id", "__key"], "left")

    names = rows.columns

    def merged(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = (batch.column(c).to_pylist() for c in (text_col, "__spans", "__places"))
        out = [spans_of(t or "", [(p["place"], p["windows"]) for p in places or ()], words, spans) for t, spans, places in zip(*columns, strict=True)]
        spans = pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        return pa.RecordBatch.from_arrays([spans if c == "__spans" else batch.column(c) for c in names], names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    # outside of the candidates there are cut units alone, of which a whole text holds the others
    rest = split.where(~F.col("__maybe")).select(rows.columns)
    whole = F.filter("__spans", lambda s: (s["start"] == 0) & (s["end"] == F.length(F.col(f"`{text_col}`"))))
    rest = rest.withColumn("__spans", F.when(F.size(whole) > 0, whole).otherwise(F.col("__spans")))
    return rest.union(arrow_map(both.select(*rows.columns, "__places"), merged, kinds))
