"""The corpus pipeline: documents in, packed training sequences out. Each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crossweave.llm.common import delete, scratch, small_batches, table_path
from crossweave.llm.decontamination import remove_spans
from crossweave.llm.exact_dedup import drop_exact
from crossweave.llm.near_texts import drop_near_texts
from crossweave.llm.packing import pack_tokens
from crossweave.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar doesn't reject; it learns from the labelled rows it may learn from."""
    small_batches(spark)
    return drop_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    small_batches(spark)
    return drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts of five-word Jaccard similarity 0.8 or more: SimHash candidates, verified."""
    small_batches(spark)
    return drop_near_texts(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of the benchmark."""
    small_batches(spark)
    return remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins, by their tokens."""
    small_batches(spark)
    return pack_tokens(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: The grammar, similarities and packing can't be expressed in SQL; tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage stores on the way, and the table before it, is deleted once its own table is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = table_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
