"""Streams over ledger tables: an extension; the batch operators define the results.

State is bounded by watermarks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.trust import content_fingerprint


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    """Event time as streams ask for it, a timestamp, with its watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def first_documents(stream: DataFrame, text: str, time: str, keep: str = "7 days") -> DataFrame:
    """Each document text's first arrival within ``keep``; later ones with its fingerprint are dropped."""
    keyed = stream.withColumn("fingerprint", content_fingerprint(F.col(text)))
    return _timed(keyed, time, keep).dropDuplicatesWithinWatermark(["fingerprint"])


def spending(stream: DataFrame, time: str = "ts", value: str = "value", by: str = "event_type", window: str = "1 day",
    late: str = "2 hours") -> DataFrame:
    """Sum and count by window and category; rows later than ``late`` are left out."""
    return _timed(stream, time, late).groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("n"),
        F.sum(value).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), by, "n", "total")


def sessions(stream: DataFrame, time: str = "ts", by: str = "user_id", gap: str = "30 minutes",
    late: str = "2 hours") -> DataFrame:
    """Rows of each user and session; a session ends after a gap."""
    return _timed(stream, time, late).groupBy(F.session_window(time, gap).alias("s"),
        by).agg(F.count("*").alias("n")).select(F.col("s.start").cast("timestamp_ntz").alias("start"),
        F.col("s.end").cast("timestamp_ntz").alias("end"), by, "n")
