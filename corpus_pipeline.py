"""A training-corpus pipeline over ``documents``: each stage is one operator, written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelog.llm import chunk_dedup, jaccard_join, packing, quality_trees, repetition
from sievelog.llm import queries as q
from sievelog.llm.shared import shared_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more stay; a null text is scored as an empty one, repeated rows alike."""
    return quality_trees.keep_good(docs, q.quality_forest(spark, docs, sf_dir), least=0.3)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep stay; null and empty texts go, repeated rows stay or go together."""
    return repetition.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays, unchanged; null texts and ids are linked with
    nothing, rows that share an id stay or go together."""
    return jaccard_join.keep_first(docs, percent=75, words_each=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out; a document that loses all its words goes. A null text stays null. Columns of ``docs`` with
    the names that the operator gives its own stay as they are."""
    own = {c: f"__own_{c}" for c in ("n_chunks", "n_cut", "cut_spans") if c in docs.columns}
    cut = chunk_dedup.dedup_substrings(docs.withColumnsRenamed(own))
    kept = cut.filter("n_cut = 0 or coalesce(text, '') rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_cut") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of 1024 tokens; equal rows each have places of their own."""
    return packing.pack_documents(docs, public_tokenizers.path(q.BYTE_BPE_JSON), capacity=1024, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]
#: Trees, rolling hashes, chunks and packing are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = q.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        folder = shared_folder(spark, f"pipeline-{i}-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
