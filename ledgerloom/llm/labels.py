"""Bounded, reproducible samples of labelled documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.runtime import discard, hash_sample, id_and_text, materialize

#: Features of all training rows that the driver takes at most; a text of some 3,000 characters has about 700.
FEATURES = 20_000_000


def crc_of_id(col: str) -> Column:
    """crc32 of an id as decimal text."""
    return F.crc32(F.col(f"`{col}`").cast("string").cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, id_col: str, text_col: str, limit: int,
    where: Column | None = None) -> DataFrame:
    """(__id, __text, label) of at most ``limit`` labelled documents, chosen by a hash of the id.

    The sample's size is bounded by ``limit``, so it is broadcast to the documents. Rows without id, label or document take no
    part; where an id has several labels, their mean decides.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if where is not None:
        known = known.where(where)
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("__id")).agg((F.avg(label) >= 0.5).cast("int")
        .alias("label"))
    chosen = hash_sample(known, limit, known.count(), "__id")
    rows = id_and_text(docs, id_col, text_col).withColumn("__id", F.col("__id").cast("bigint"))
    return rows.join(F.broadcast(chosen), "__id")


def fetch_features(made: DataFrame, most: int = FEATURES) -> tuple[pa.Table, list[int]]:
    """Training rows (__id, label, ids, ...) with at most ``most`` features (entries of ``ids``) in all, and their numbers in order of ``__id``.

    Where the sample has more, rows with the most features are left out, ties by id: a few very long texts make way, and what reaches the
    driver is bounded in bytes as well as in rows.
    """
    table = materialize(made, "training-features")
    sizes = table.select(F.size("ids").alias("n"), "__id").toArrow()
    sizes = sorted(zip(sizes["n"].to_pylist(), sizes["__id"].to_pylist(), strict=True))
    total, kept = 0, []
    for n, i in sizes:
        total += n
        if total > most:
            break
        kept.append(i)
    rows = table if len(kept) == len(sizes) else table.where(F.col("__id").isin(kept))
    got = rows.toArrow()  # not sorted itself, which would be a second copy
    discard(table)
    return got, np.argsort(got["__id"].to_numpy(), kind="stable").tolist()
