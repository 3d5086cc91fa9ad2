"""The registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import adaptive_rules as rules
from ledgerloom.llm import spelling
from ledgerloom.llm.alignment import align_tokenizers
from ledgerloom.llm.hmm_model import train_and_score
from ledgerloom.llm.kmeans_tree import search
from ledgerloom.llm.labels import crc_of_id
from ledgerloom.llm.line_dedup import remove_repeated_units
from ledgerloom.llm.minhash_dedup import near_duplicates
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.prefix_table import encode_decode
from ledgerloom.llm.quality_model import score_quality
from ledgerloom.llm.suffix_dedup import remove_repeated_strings
from ledgerloom.llm.toxicity_chain import score_toxicity
from ledgerloom.llm.wordpiece_counts import wordpiece_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and passages of over 50 words stay where they first occur in ``documents``."""
    return remove_repeated_units(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=51,
        passage_words=51)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), model_path=public_tokenizers.path("piece_bpe_32k.model"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``; labels of the held-out quarter are never read into training. A null id is not held out."""
    held_out = F.coalesce(F.pmod(crc_of_id("doc_id"), F.lit(4)) == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, table(spark, sf_dir, "labels"), where=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth row of ``embeddings``, against all others."""
    return search(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 100 == 0, k=10)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.adaptive_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of ``documents`` by their two-word shingles, as the contract fixes them."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary=public_tokenizers.path("byte_bpe_50k.json"))


def op9_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece_counts(table(spark, sf_dir, "documents"), vocabulary=public_tokenizers.path("word_bpe_49k.json"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), byte_vocabulary=public_tokenizers.path("byte_bpe_50k.json"),
        piece_model=public_tokenizers.path("piece_bpe_32k.model"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of ``documents`` without the strings of 200 bytes that occur twice."""
    out = remove_repeated_strings(table(spark, sf_dir, "documents"), width=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_toxicity": op4_toxicity,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_quality_rules": op6_quality_rules,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_packing": op8_packing,
    "op9_hmm_scores": op9_hmm_scores,
    "op10_token_counts": op10_token_counts,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_suffix_dedup": op13_suffix_dedup,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op6_quality_rules": rules.ORACLE_SQL,
    "op12_spelling_variants": spelling.ORACLE_SQL,
}
