"""Operator 1: remove text units (lines or paragraphs) that occur earlier in the corpus."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from xxhash import xxh3_128_digest

from ledgerloom.llm.passages import add_repeated_passages
from ledgerloom.llm.runtime import arrow_map, discard, materialize

#: A unit and the separator after it.
SEPARATORS = {"line": re.compile("\n"), "paragraph": re.compile(r"\n[ \t\r]*\n\s*")}


def units_of(text: str, unit: str) -> list[tuple[int, int, int]]:
    """(start, end, next start) of each unit, in characters; together they cover the text."""
    out, at = [], 0
    for m in SEPARATORS[unit].finditer(text):
        out.append((at, m.start(), m.end()))
        at = m.end()
    out.append((at, len(text), len(text)))
    return out


def normal_form(unit: str) -> tuple[bytes, int]:
    """What two equal units share: lower-cased words with single spaces; and the number of words."""
    words = unit.lower().split()
    return " ".join(words).encode("utf-8", "surrogatepass"), len(words)


def unit_digests(docs: DataFrame, unit: str, min_words: int, whole_words: int | None = None) -> DataFrame:
    """A row per unit of ``min_words`` words or more: document, row key, place, character span, 128-bit digest.

    A text of several units and ``whole_words`` words or more is a unit as well, at place -1.
    """
    id_type = docs.schema["__id"].dataType.simpleString()

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, place, start, end, digest, units = [], [], [], [], [], np.zeros(batch.num_rows, np.int64)
        for k, text in enumerate(batch.column("__text").to_pylist()):
            if not text:
                continue
            found = [(n, min_words, *x) for n, x in enumerate(units_of(text, unit))]
            if whole_words is not None and len(found) > 1:
                found.append((-1, whole_words, 0, len(text), len(text)))
            for n, least, a, b, after in found:
                form, words = normal_form(text[a:b])
                if words >= least:
                    row.append(k)
                    units[k] += n >= 0
                    place.append(n)
                    start.append(a)
                    end.append(after)
                    digest.append(xxh3_128_digest(form))
        two = np.frombuffer(b"".join(digest), ">i8").astype(np.int64).reshape(-1, 2)
        pick = pa.array(row, pa.int32())
        return pa.RecordBatch.from_arrays(
            [batch.column("__id").take(pick), batch.column("__key").take(pick),
                *(pa.array(x, pa.int32()) for x in (place, start, end)), pa.array(two[:, 0]), pa.array(two[:, 1]),
                pa.array(units).take(pick)],
            names=["__id", "__key", "place", "start", "end", "hi", "lo", "units"])

    return arrow_map(docs, fn,
        f"__id {id_type}, __key bigint, place int, start int, end int, hi bigint, lo bigint, units bigint")


def remove_repeated_units(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = 5,
    passage_words: int | None = None,
) -> DataFrame:
    """Keep each unit where it first occurs in the corpus and cut it everywhere else.

    ``unit`` is ``line`` or ``paragraph``. Units are compared by their lower-cased
    words (white space does not count); shorter ones than ``min_words`` words are never cut,
    as such lines recur by chance. Rank is (id, place in the text): the smallest
    keeps the unit, also within one document.

    Returns the input's columns with ``text_col`` cut, and ``n_units`` and
    ``n_removed`` (long) and ``removed``: the cut spans as
    ``array<struct<start, end>>`` of character offsets in the original text,
    each including the separator after the unit.

    With ``passage_words``, runs of so many words or more whose equal stands earlier in the corpus are cut as well,
    wherever in a line they start and end; cuts that overlap are one span.

    A digest's rows are reduced to their smallest place before the shuffle, and only
    digests that occur twice or more are joined back, by a join that adaptive execution
    may split; so a unit that stands in a third of all rows meets in no single task.

    Defined cases: ids are whole numbers or strings (others are compared as strings); null and empty texts pass unchanged with
    0 units; a null id ranks after all others; rows of one id and one text count as a single
    occurrence and are cut alike; of rows that share an id but differ in text, the smaller hash of the text ranks first; equal
    units within a text: the first stays; texts are cut whole, however long; columns named like a result are replaced;
    no rows give no rows. A document of which nothing is left stays with an empty text.
    """
    if unit not in SEPARATORS:
        raise ValueError(f"unit must be one of {sorted(SEPARATORS)}")
    whole_number = isinstance(docs.schema[id_col].dataType, IntegralType)
    rank = F.col(f"`{id_col}`").cast("bigint" if whole_number else "string")
    rank = F.coalesce(rank, F.lit(2**63 - 1 if whole_number else "\U0010ffff"))
    keyed = docs.withColumns({"__id": rank, "__key": F.xxhash64(F.col(f"`{text_col}`"))})
    rows = keyed.select("__id", "__key", F.col(f"`{text_col}`").alias("__text"))
    units = materialize(unit_digests(rows, unit, min_words, passage_words), "units")
    place = F.struct("__id", "__key", "place")
    repeated = units.groupBy("hi", "lo").agg(F.min(place).alias("first"),
        F.count("*").alias("times")).where("times > 1").select("hi", "lo", "first")
    repeated = materialize(repeated, "repeated")  # a plain scan below the join lets a hot digest's partition be split
    span = F.when(F.col("first").isNotNull() & (place != F.col("first")), F.struct("start", "end"))
    found = (units.join(repeated, ["hi", "lo"], "left").groupBy("__id", "__key")
             .agg(F.max("units").alias("__units"), F.array_sort(F.collect_set(span)).alias("__spans")))

    both = keyed.join(found, ["__id", "__key"], "left")
    both = both.withColumns({"__spans": F.coalesce("__spans", F.array().cast("array<struct<start:int,end:int>>")),
        "n_units": F.coalesce("__units", F.lit(0).cast("bigint"))}).drop("__units")
    if passage_words is not None:
        both = materialize(both, "lines")
        discard(units)
        discard(repeated)
        both = add_repeated_passages(both, text_col, passage_words)
    both = both.drop("__id", "__key")
    text = F.col(f"`{text_col}`")
    # the text between cuts, by character offsets; what follows the last cut is everything to the end
    starts = F.concat(F.array(F.lit(0)), F.transform("__spans", lambda s: s["end"]))
    ends = F.concat(F.transform("__spans", lambda s: s["start"]), F.array(F.length(text)))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(text, a + 1, b - a))
    joined = F.array_join(pieces, "")
    at_end = F.element_at(F.col("__spans"), -1)["end"] == F.length(text)
    shorter = F.when(F.size("__spans") == 0,
        text).otherwise(F.when(at_end, F.regexp_replace(joined, r"\n\z", "")).otherwise(joined))
    return both.withColumns({text_col: shorter, "n_removed": F.size("__spans").cast("bigint"),
        "removed": F.col("__spans")}).drop("__spans")
