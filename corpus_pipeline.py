"""A corpus from raw documents to packed batches, in stages written as Parquet.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm.common import discard, scratch, shared_dir, small_batches, written
from meshlark.llm.decontam import clean_documents
from meshlark.llm.line_dedup import apply_bitmaps, keep_bitmaps
from meshlark.llm.near_dedup import keep_first, near_duplicates
from meshlark.llm.packing import pack_tokens
from meshlark.llm.queries import bpe
from meshlark.llm.toxicity import drop_toxic, train_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. It learns from four fifths of the labels."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train_toxicity(docs, labels, where=F.crc32(F.col("id").cast("string")) % 5 != 0)
    return drop_toxic(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more stay only in the one with the largest id.

    Documents of which no line is left go: all that they held is in other documents.
    """
    small_batches(spark)
    return apply_bitmaps(docs, keep_bitmaps(docs), drop_emptied=True).withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    small_batches(spark)
    return keep_first(docs, near_duplicates(docs, shingle=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat ten words in a row of a benchmark item go."""
    small_batches(spark)
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of each remaining document, by its number of tokens."""
    small_batches(spark)
    return pack_tokens(docs, bpe(), with_ids=False)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: The trained model has no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again; what is no longer read is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, path = docs, shared_dir(spark)
        with scratch(spark):  # what the stage wrote on its way
            docs = written(stage(spark, docs, sf_dir), path)
        discard(before)
    return docs
