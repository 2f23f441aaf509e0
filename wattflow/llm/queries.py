"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate, digest
from .jaccard import near_duplicates
from .language import identify_languages
from .oracle import ORACLE_SQL as ORACLE_SQL
from .packing import pack
from .prefix_trie import prefix_trie
from .quality import quality_rules
from .sharding import place
from .substrings import repeated_passages
from .token_counts import token_counts
from .token_files import token_files
from .toxicity import score_toxicity
from .vector_codes import vector_codes
from .warc import archives


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op6_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(spark, table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))


def op8_maximal_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op9_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_lookup_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = place(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return placed.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "slot", "shard_id", "shard")


def op2_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark, table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(spark, table(spark, sf_dir, "documents"))


def op12_prefix_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_trie(spark, table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_exponion_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes(spark, table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_paragraph_minhash": op2_paragraph_minhash,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_best_two_fit": op4_best_two_fit,
    "op5_warc_normaliser": op5_warc_normaliser,
    "op6_robust_outliers": op6_robust_outliers,
    "op7_token_files": op7_token_files,
    "op8_maximal_segments": op8_maximal_segments,
    "op9_positional_index": op9_positional_index,
    "op10_lookup_table": op10_lookup_table,
    "op11_hyperdimensional_language": op11_hyperdimensional_language,
    "op12_prefix_intervals": op12_prefix_intervals,
    "op13_exponion_codes": op13_exponion_codes,
}
