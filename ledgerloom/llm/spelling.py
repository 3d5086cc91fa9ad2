"""Operator 12: group spelling variants, words of the corpus that are one edit apart, by letter-parity masks."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.runtime import SLICE_BYTES, SLICE_ROWS, arrow_map, discard, id_and_text, materialize, ship

#: Maximal runs of a-z and U+00C0 to U+00FF in UTF-8; A-Z are lower-cased before.
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Distinct words that a task counts before it hands them on.
HELD = 1 << 18
#: A mask has three bands of so many bits.
BAND_BITS = 21


def spell(run: bytes, at: int) -> bytes:
    """``run`` without its code point ``at``."""
    text = run.decode()
    return (text[:at] + text[at + 1 :]).encode()


def count_words(texts: Iterator[tuple[object, bytes | None]], noise: int, counts: Counter) -> None:
    """Add the words of (id, text) pairs to ``counts``; where ``noise`` divides the crc32 of ``<id>:<run>``, the run loses a code point."""
    for name, text in texts:
        if not text:
            continue
        start = zlib.crc32(f"{'' if name is None else name}:".encode())
        for run, n in Counter(RUN.findall(text.translate(_LOWER))).items():
            h = zlib.crc32(run, start)
            if h % noise == 0:
                run = spell(run, h % len(run.decode()))
            counts[run] += n


def word_counts(docs: DataFrame, noise: int) -> DataFrame:
    """(word, n): partial counts; a task holds at most ``HELD`` words and those of one slice of its rows."""
    ship(docs.sparkSession)

    def rows(counts: Counter) -> pa.RecordBatch:
        words = pa.array(list(counts), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            step = max(1, min(SLICE_ROWS, SLICE_BYTES * batch.num_rows // max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                texts = part.column("__text").cast(pa.large_binary()).to_pylist()
                count_words(zip(part.column("__id").to_pylist(), texts, strict=True), noise, counts)
                if len(counts) >= HELD:
                    yield rows(counts)
                    counts.clear()
        if counts:
            yield rows(counts)

    return docs.mapInArrow(run, "word string, n bigint")


def letter_bits() -> np.ndarray:
    """The mask of each code point up to U+00FF: a to z have a bit of their own, dealt over the bands in turn, the others share what bits are left."""
    bits = np.zeros(256, np.int64)
    for k in range(26):
        bits[97 + k] = 1 << (k % 3 * BAND_BITS + k // 3)
    free = [b * BAND_BITS + k for k in range(9, BAND_BITS) for b in range(3)]
    for k in range(0xC0, 0x100):
        bits[k] = 1 << free[(k - 0xC0) % len(free)]
    return bits


def parity_masks(words: list[str]) -> np.ndarray:
    """Of each word the exclusive or of its letters' bits: which letters occur an odd number of times."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(w) for w in words])
    return np.bitwise_xor.reduceat(letter_bits()[points], np.concatenate([[0], ends[:-1]])) if words else np.empty(0, np.int64)


def with_masks(words: DataFrame) -> DataFrame:
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(parity_masks(batch.column("word").to_pylist()))], names=["word", "n", "mask"])

    return arrow_map(words, fn, "word string, n bigint, mask bigint")


def _band(mask: Column, k: int) -> Column:
    return F.shiftrightunsigned(mask, k * BAND_BITS).bitwiseAND(F.lit((1 << BAND_BITS) - 1))


def _keyed(words: DataFrame, shorter: Column, kind: int) -> DataFrame:
    """A row per band and half of a word, for pairs whose shorter word has ``shorter`` letters."""
    half = F.floor(shorter / 2).cast("int")
    halves = (F.substring(F.col("word"), F.lit(1), half), F.substring(F.col("word"), F.length("word") - half + 1, half))
    keys = F.array(*(F.struct(F.lit(3 * s + b).alias("place"), F.xxhash64(F.lit(3 * s + b), _band(F.col("mask"), b), shorter, h).alias("key"))
        for s, h in enumerate(halves) for b in range(3)))
    return words.select("word", "n", "mask", F.lit(kind).alias("kind"), F.explode(keys).alias("k")).select("word", "n", "mask", "kind", "k.*")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each pair of ``words`` (word, n, mask) that one inserted, deleted or replaced code point turns into each other, once.

    An edit flips at most two bits of the parity mask, so of three bands one is equal; and it lies in one half of the word, so
    the other half is equal, too. Words meet by an equal band together with an equal half, at the same length or at one more;
    a pair goes on from the first band and half that it shares, if its masks differ in two bits at most, to the comparison
    of its letters.
    """
    size = F.length("word")
    short, long = _keyed(words, size, 0), _keyed(words, size - 1, 1)
    left = short.select("key", F.col("place"), F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("mask").alias("a_mask"))
    right = short.union(long).select("key", F.col("place").alias("b_place"), F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("mask").alias("b_mask"), "kind")
    c = F.col
    flipped = c("a_mask").bitwiseXOR(c("b_mask"))
    band, half = c("place") % 3, F.floor(F.length("a") / 2).cast("int")
    first = ((band < 1) | (_band(flipped, 0) != 0)) & ((band < 2) | (_band(flipped, 1) != 0))
    first &= (c("place") < 3) | (F.substring(c("a"), F.lit(1), half) != F.substring(c("b"), F.lit(1), half))
    once = (c("kind") == 1) | (c("a") < c("b"))
    met = left.join(right, (left["key"] == right["key"]) & (c("place") == c("b_place")) & once & (F.bit_count(flipped) <= 2) & first)
    return met.where(F.levenshtein(c("a"), c("b"), 1) == 1).select("a", "a_n", "b", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of ``forms`` (word, form), by joins that double the steps made.

    A form occurs ``ratio`` times as often as its word or more, so chains are short (63 steps at most with a ratio of 2) and have no cycles.
    """
    live = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = live.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(live.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(live)
        live = step
        if not live.where("moved").head(1):
            return live.select("word", "root")


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3, ratio: int = 2,
    noise: int = 97) -> DataFrame:
    """The words of all texts with the more frequent spelling each stands for.

    Words are maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z lower-cased; where ``noise`` divides the crc32 ``h`` of ``<id>:<run>``,
    the run loses its code point ``h`` modulo its length. Words of ``min_length`` code points and ``min_count`` occurrences take part.

    Returns ``word``, ``form`` (the near word of largest count, ties to the smallest in code-point order, if it occurs
    ``ratio`` times as often as the word or more; else null), ``root`` (the last of the chain of forms; the word itself if it has none),
    ``n``, ``n_near`` and ``form_n``.

    Counts are combined in a task before they are shuffled, so frequent words are no hot keys; what is joined is the
    vocabulary, never the text. Very long texts are read whole, their words counted at once.

    Defined cases: null and empty texts have no words; a null id counts as an empty one; repeated rows count as often as they
    stand there; other columns are ignored whatever their names; no words give no rows.
    """
    if min_length < 2 or ratio < 2:
        raise ValueError("min_length and ratio are 2 at least")
    counts = word_counts(id_and_text(docs, id_col, text_col), noise)
    counts = counts.where(F.length("word") >= min_length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    words = materialize(with_masks(counts), "words")
    pairs = materialize(near_pairs(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(pairs.select("b", "a", "a_n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = words.select("word", "n").join(best, "word", "left")
    form = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best"))
    known = materialize(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), form["near"].alias("form"), (-form["less"]).alias("form_n")), "forms")
    discard(words)
    discard(pairs)
    ends = roots(known.where("form is not null"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same in SQL: crc32 byte by byte, and near words by what is left when one code point goes.
ORACLE_SQL = r"""
with recursive bits(k, v) as (select 0, list_transform(range(0, 256), lambda x: x::bigint) union all
  select k + 1, list_transform(v, lambda x: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end) from bits where k < 8),
crc as (select v as t from bits where k = 8),
runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) as run from documents),
seen as (select doc_id, run, count(*) as n from runs group by all),
hashed as (select run, n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, strlen(s)), lambda k: ('0x' || substr(hex(encode(s)), 2 * k::int + 1, 2))::bigint)),
  lambda a, b: xor(a // 256, t[(xor(a, b) & 255) + 1])), 4294967295) as h
  from (select run, n, coalesce(doc_id::varchar, '') || ':' || run as s from seen) cross join crc),
spelt as (select case when h % 97 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed),
words as (select word, sum(n)::bigint as n from spelt where length(word) >= 5 group by word having sum(n) >= 3),
less as (select word, n, k, left(word, k::int) || substr(word, k::int + 2) as rest from (select word, n, unnest(range(0, length(word))) as k from words)),
near as (select a.word, b.word as other, b.n as other_n from less a join less b on a.rest = b.rest and a.k = b.k and a.word <> b.word
  union select a.word, b.word, b.n from less a join words b on a.rest = b.word union select b.word, a.word, a.n from less a join words b on a.rest = b.word),
best as (select word, count(*)::bigint as n_near, arg_min(other, (-other_n, other)) as form, max(other_n)::bigint as form_n from near group by word),
known as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when form_n >= 2 * w.n then form end as form, case when form_n >= 2 * w.n then form_n end as form_n
  from words w left join best b on w.word = b.word),
chain(word, last) as (select word, form from known where form is not null union all select c.word, k.form from chain c join known k on c.last = k.word where k.form is not null),
ends as (select word, arg_max(last, n) as root from (select c.word, c.last, k.n from chain c join known k on c.last = k.word) group by word)
select k.word, form, coalesce(root, k.word) as root, n, n_near, form_n from known k left join ends e on k.word = e.word
"""
