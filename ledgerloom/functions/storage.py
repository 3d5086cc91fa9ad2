"""Cutting lineage with tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: By application, the tables that ``materialize`` has written and that are still there.
_WRITTEN: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local folder only where that is unset and one process does all the work."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; the files survive the loss of an executor."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, set()).add(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_lean(df: DataFrame, tag: str) -> DataFrame:
    """As ``materialize``, with denser files, and what was shuffled to make the table is deleted once it is written."""
    spark, path, key = df.sparkSession, f"{shared_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> set[str]:
    """The tables of this session that are there now."""
    return set(_WRITTEN.get(spark.sparkContext.applicationId, ()))


def discard_others(kept: DataFrame, before: set[str]) -> DataFrame:
    """``kept``, a ``materialize``d frame; the tables written since ``before`` but its own are deleted."""
    spark = kept.sparkSession
    own = {f.rpartition("/")[0].rpartition("/")[2] for f in kept.inputFiles()}
    for path in written(spark) - before:
        if path.rpartition("/")[2] not in own:
            _delete(spark, path)
    return kept


def together(spark: SparkSession) -> None:
    """From now on, rows that were dealt out by some of a join's keys stay where they are for that join, instead of being shuffled anew by all of them."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def release(spark: SparkSession) -> int:
    """Delete every table of this session that ``materialize`` has written and nobody discarded; returns how many.

    A lazy result reads such tables, so this is called once results are written: after a job's last one, or between jobs of a long session.
    """
    paths = list(_WRITTEN.get(spark.sparkContext.applicationId, ()))
    for path in paths:
        _delete(spark, path)
    return len(paths)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    _WRITTEN.get(spark.sparkContext.applicationId, set()).discard(folder)


def discard(df: DataFrame) -> None:
    """Delete the files behind a ``materialize``d frame that is no longer read."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        own = next((p for p in _WRITTEN.get(df.sparkSession.sparkContext.applicationId, ()) if folder.endswith(p.partition("://")[2] or p)), folder)
        _delete(df.sparkSession, own)
