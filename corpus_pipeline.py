"""A training corpus out of raw documents.

Documents that the quality classifier rejects go; of near-duplicates one stays;
documents that hold test items go; sources are mixed to their weights (a document
comes as often as the mix takes it, so down-weighted sources lose documents and others
repeat); and every row gets its shard. Each stage reads what the one before wrote.
Labels and test items are the tables `labels` and `benchmark` beside the documents.

Stages read doc_id, text and source; all other columns go through as they are, whatever
their names, but for `shard` and `virtual_slot`, which the last stage adds: columns of
these names come out with `input_` before them. Null and empty texts count as empty: the
classifier scores them like any other, they are near to nothing, hold no test item, take
no words of the mix and stay once. Rows without an id are rows like others: of equal ones
one stays, as of rows equal in id and text. A null source is a source. Ties go to the
smallest id, or by hash. Empty tables pass through; without labels all documents stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.llm import decontaminate, minhash, mixing, quality, shards
from catalens.llm.store import materialise, scratch, scratch_area
from catalens.sources.files import remove

#: Five-word shingles and a similarity of 0.8 for near-duplicates.
SHINGLE, PERCENT = 5, 80
SHARDS = 16


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from all labels of `docs`."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(quality.document_statistics(docs), labels)
    return docs.where(quality.score_text(F.col("text"), model) >= 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates."""
    return minhash.one_of_each(docs, SHINGLE, PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with their slot and shard."""
    sharded, _ = shards.assign_shards(docs, SHARDS)
    return sharded


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("sharding", sharding),
]

#: Classifier, signatures and alignments have no SQL; tests use a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        before, written = written, scratch(spark)
        with scratch_area(spark):  # what a stage wrote for itself goes with it
            docs = materialise(stage(spark, docs, sf_dir), written)
        if before:
            remove(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
