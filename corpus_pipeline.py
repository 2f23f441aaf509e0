"""The corpus pipeline: documents through five stages, each written as Parquet and read again before the next.

The stages drop toxic documents, all but one of each group of near copies, passages that repeat across documents (and
documents of nothing else), and documents with passages of the benchmark; the last packs what is left into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattflow.llm.decontaminate import decontaminate
from wattflow.llm.jaccard import near_duplicates
from wattflow.llm.packing import pack
from wattflow.llm.scratch import Scratch
from wattflow.llm.substrings import remove_passages, repeated_passages
from wattflow.llm.toxicity import score_toxicity

#: Ids are broadcast up to this number, else joined by a shuffle.
BROADCAST_IDS = 2_000_000


def _without(spark: SparkSession, docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """docs without the rows of the ids (doc_id). Rows without an id stay."""
    found = Scratch(spark, name).save(ids.where("doc_id is not null").distinct(), "dropped")
    few = found.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(found) if few else found.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. Of rows with equal ids one that is drops all."""
    scored = score_toxicity(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(spark, docs, scored.where("predicted = 1").select("doc_id"), "toxicity")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies. Of rows with equal ids one of each component stays, and of those without words one of each text."""
    found = Scratch(spark, "copies").save(near_duplicates(spark, docs), "components")
    once = _without(spark, docs, found.where("component_id != doc_id").select("doc_id"), "copies")
    own = found.where("component_id = doc_id")
    repeated = own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if repeated.isEmpty():
        return once
    repeated = Scratch(spark, "copies").save(repeated, "repeated")
    kept = own.join(repeated.hint("merge"), "doc_id", "left_semi").groupBy("doc_id", F.coalesce("component_key", "text_key")).agg(F.min("text_key").alias("kept_key")).select(F.col("doc_id").alias("kept_id"), "kept_key")
    several = once.join(repeated.hint("merge"), "doc_id", "left_semi")
    chosen = several.join(kept.hint("merge"), (several["doc_id"] == kept["kept_id"]) & (F.xxhash64(several["text"]) == kept["kept_key"]), "left_semi")
    return _without(spark, once, repeated, "copies").unionByName(chosen.dropDuplicates(["doc_id", "text"]).select(*once.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages whose first copy is in another one; those of which nothing is left go."""
    cut = remove_passages(docs.withColumn("__empty", F.coalesce(F.trim("text"), F.lit("")) == ""), repeated_passages(spark, docs))
    left = cut.where((F.trim("text") != "") | F.col("__empty"))
    chars = {"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return left.withColumns(chars).select(*docs.columns) if chars else left.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(spark, docs, found.where("n_hit > 0").select("doc_id"), "decontaminate")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets."""
    return pack(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_two_fit_packing", packing),
]

#: Fitted scores, tokenizers and components are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{number}-{name}")
        if number:
            scratch.drop(f"{number - 1}-{STAGES[number - 1][0]}")
    return docs
