"""The operators bound to the test tables: one query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.llm import (
    centroids, chat, decontaminate, infill, licenses, minhash, mixing, nndescent, quality, shards, tokencount, tokenfile, warc,
)
from catalens.llm.store import materialise, scratch
from catalens.llm.vocab import read_vocabulary

VOCABULARY = "byte_bpe_50k.json"
SHORT_TEXT = 1024  # bytes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_warc(_table(spark, sf_dir, "pages"), revisit_from=0, file_bytes=16 << 20)
    return warc.read_warc(spark, folder, payloads=False).drop("payload", "file", "target_uri")


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame(
        [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string"
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.parse_conversations(materialise(chat.format_conversations(turns))))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_documents(_table(spark, sf_dir, "documents"), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenfile.write_tokens(_table(spark, sf_dir, "documents"), read_vocabulary(VOCABULARY), end_id=2)
    return tokenfile.read_tokens(spark, folder)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed, _ = mixing.mix(documents)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries: short texts, which repeat most, are counted first; then all documents,
    whose short texts come from the cache."""
    documents, vocabulary, cache = _table(spark, sf_dir, "documents"), read_vocabulary(VOCABULARY), scratch(spark)
    tokencount.fill_cache(documents.where(F.octet_length("text") <= SHORT_TEXT), vocabulary, cache)
    return tokencount.token_counts(documents, vocabulary, cache)


def op9_nndescent(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = nndescent.build(embeddings, kept=6)
    return nndescent.nearest(index, embeddings, embeddings.where(F.col("vec_id") % 50 == 0), k=5)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.label_documents(_table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, found = centroids.cluster_vectors(_table(spark, sf_dir, "embeddings"))
    return centroids.with_inertia(assigned, found)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    formed = infill.restore(infill.transform(_table(spark, sf_dir, "documents")))
    return formed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_warc, op2_chat, op3_decontaminate, op4_shards, op5_minhash, op6_tokens, op7_mixing, op8_tokencount, op9_nndescent,
        op10_quality, op11_licenses, op12_centroids, op13_infill,
    ]
    return {f.__name__: f for f in own}
