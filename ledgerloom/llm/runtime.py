"""What the corpus operators share: a place that all executors see, and column hygiene."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.shipping import ship
from ledgerloom.functions.storage import discard, materialize, shared_dir

__all__ = ["arrow_map", "arrow_score", "discard", "hash_sample", "id_and_text", "materialize", "shared_dir", "ship",
    "utf8_bytes"]
#: Rows, and bytes as far as rows are no longer, that a function sees at once.
SLICE_ROWS, SLICE_BYTES = 1024, 4 << 20


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator works on, under names that cannot clash."""
    return docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))


def hash_sample(df: DataFrame, limit: int, total: int, *keys: str) -> DataFrame:
    """The ``limit`` rows with the smallest hash of ``keys``, of about ``total``.

    ``keys`` tell rows apart: rows equal in them have one hash, and where very many are equal, fewer than ``limit`` may be left.
    Rows whose hash cannot be among the smallest are filtered out first, so what is sorted and sent to one place
    does not grow with the table.
    """
    h = F.xxhash64(*keys)
    share = (limit + 8 * limit**0.5 + 32) / max(total, 1)
    near = df.where(h < int(-(2**63) + share * 2**64)) if share < 0.5 else df
    return near.orderBy(h, *keys).limit(limit)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch; batches are bounded, partitions never are held whole."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(SLICE_ROWS, SLICE_BYTES * batch.num_rows // max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                yield fn(batch.slice(at, step))

    return df.mapInArrow(run, schema)


def arrow_score(
    docs: DataFrame, fn: Callable[[list[bytes | None]], list[pa.Array]], fields: list[tuple[str, str]], *,
    id_col: str, text_col: str, keep_columns: bool,
) -> DataFrame:
    """Columns ``fields`` (name, type) that ``fn`` makes of a batch's texts, beside the id or, on demand, beside all
    columns of ``docs``, of which those named like a result are replaced. One pass, no shuffle."""
    names = [n for n, _ in fields]
    base = docs.drop(*(n for n in names if n not in (id_col, text_col))) if keep_columns else docs.select(id_col,
        text_col)
    columns = base.columns if keep_columns else [id_col]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = fn(utf8_bytes(batch.column(text_col)))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *made], names=[*columns, *names])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name in columns),
        *(f"`{n}` {t}" for n, t in fields)])
    return arrow_map(base, one, kinds)


def utf8_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column as raw UTF-8, without decoding it to Python strings."""
    return column.cast(pa.large_binary()).to_pylist()
