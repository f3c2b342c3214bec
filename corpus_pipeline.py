"""From raw documents to packed training sequences. Each stage applies one operator to all
rows that the stage before it has kept.

The first four stages return the columns of documents; line dedup also brings n_chars up to
date. The last returns the pieces of the packed sequences with their token ids. Nulls, empty
texts, repeated rows and empty tables are treated as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import line_dedup, odd_sketch, packing, tiling, toxicity
from tallymill.session import stored

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. The classifier learns from the
    labels of the given documents that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(toxicity.labelled_rows(docs, labels)))


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more stay in one of them only."""
    kept = line_dedup.drop_shared_lines(docs).drop("n_lines", "n_dropped")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: runs of five words, similarity 0.8."""
    return odd_sketch.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item's words or more in tiles go."""
    return tiling.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 token ids."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("toxicity", toxic_documents),
    ("line_dedup", shared_lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("packing", packed_sequences),
]

# Classifier, sketches and token ids are beyond SQL; a brute-force version tests the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
