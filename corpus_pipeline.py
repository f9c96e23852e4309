"""A training corpus from ``documents``: each stage calls one of the operators in geneloom/llm and works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geneloom.llm import decontaminate, line_dedup, ngram_join, packing, pu_quality
from geneloom.llm.text import materialize, table


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from the labels outside the held-out fold and the texts it gets."""
    return pu_quality.remove_rejected(docs, pu_quality.trusted_ids(table(spark, sf_dir, "labels")))


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay only in the document with the largest id."""
    return line_dedup.deduplicate_lines(docs).select(docs.columns)


def deduplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id stays. Shingles have five words, as in any stage of a pipeline;
    the limit is a Jaccard similarity of 0.8."""
    return ngram_join.keep_one(docs, size=5, percent=80)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality", reject_low_quality), ("line_dedup", deduplicate_lines), ("near_duplicates", deduplicate_documents),
          ("decontaminate", remove_benchmarks), ("packing", pack)]
ORACLE_SQL = None  # SQL states neither the classifier nor the packing


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
