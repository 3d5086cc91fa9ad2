"""A corpus pipeline of five of the training-data operators.

``STAGES`` lists (name, function). Each function takes (spark, docs, sf_dir) and works on all that its
predecessor kept; all but the last return the columns of documents.

Defined cases, of all stages: null ids and texts, empty and very long texts pass the filters unless their own score rejects
them, and are never duplicates of anything; texts are read whole. Repeated rows are scored alike; near dedup leaves one row of
those that share id and text. Among equals the smallest id, and within a text the earliest place, stays. Further columns pass
unchanged, whatever their names, to the last stage, which replaces them by its own. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.line_dedup import remove_repeated_units
from ledgerloom.llm.minhash_dedup import near_duplicates
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.quality_model import score_quality
from ledgerloom.llm.runtime import materialize
from ledgerloom.llm.toxicity_chain import score_toxicity


def _guarded(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs`` whose columns but id and text have names that no operator's result has, and back under their own names."""
    safe = {n: n if n in ("doc_id", "text") else f"__column_{k}" for k, n in enumerate(docs.columns)}
    out = work(docs.select(*(F.col(f"`{n}`").alias(x) for n, x in safe.items())))
    return out.select(*(F.col(x).alias(n) for n, x in safe.items()))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _guarded(docs, lambda d: score_toxicity(d, labels, keep_columns=True).where("kept"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7 go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _guarded(docs, lambda d: score_quality(d, labels, keep_columns=True).where("predicted = 1"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8) the smallest id stays; of rows that share an id and a text, one."""
    texts = F.xxhash64("text")
    twice = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("count"), (F.min(texts) != F.max(texts)).alias("differ")).where("count > 1")
    twice = materialize(twice, "repeated-ids")
    if twice.where("differ").head(1):
        return _near_dedup_of_texts(docs)
    groups = near_duplicates(docs, shingle_words=5, percent=80)
    gone = materialize(groups.where("not kept").select("doc_id").distinct(), "near-duplicates")
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    if not twice.head(1):
        return kept
    return kept.join(twice, "doc_id", "left_anti").select(docs.columns).union(kept.join(twice, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))


def _near_dedup_of_texts(docs: DataFrame) -> DataFrame:
    """Near dedup where rows share an id but differ in text: each id and text is a document of its own; of a group the smallest id's stays."""
    nodes = materialize(docs.withColumn("__node", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))), "nodes")
    groups = near_duplicates(nodes, id_col="__node", shingle_words=5, percent=80).select("__node", "component_id").distinct()
    ids = nodes.where("__node is not null").select("__node", "doc_id").distinct()
    first = groups.join(ids, "__node").groupBy("component_id").agg(F.min(F.struct("doc_id", "__node"))["__node"].alias("__node"))
    kept = nodes.join(materialize(first, "kept-nodes"), "__node", "left_semi").dropDuplicates(["__node"])
    return kept.select(docs.columns).union(nodes.where("__node is null").select(docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines and passages of over 50 words that stand earlier, by id and place, are cut; ``n_chars`` follows the text."""
    out = _guarded(docs, lambda d: remove_repeated_units(d, min_words=51, passage_words=51))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left becomes sequences of at most 1024 tokens: a row per piece."""
    return pack_documents(docs, vocabulary=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("packing", packing)]

#: The classifiers and the packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet to the shared folder and reread by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
