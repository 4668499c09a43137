"""Token counts with a digest cache.

A text's count is stored under two digests: of its content (SHA-256 of the UTF-8
bytes; null counts as empty) and of the tokenizer's version (vocabulary file and
library). Documents are joined to the stored counts; of the texts without one, each
distinct text is encoded once and its count appended to the cache. Content is not
normalised further, as any change to a text may change its count.

Every row gets a count: null and empty texts 0, repeated rows the same one, texts of
any length whole. A null id stays null. Only the id and text columns are read, so
extra columns can't clash. An empty table gives an empty result and appends nothing.
Two jobs that append at once may store a count twice; reading takes one of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.llm.store import materialise, scratch
from catalens.llm.vocab import encoder, version_digest

CACHE_SCHEMA = T.StructType([
    T.StructField("content", T.BinaryType()),
    T.StructField("tokenizer", T.StringType()),
    T.StructField("n_tokens", T.LongType()),
])


def _content(text) -> F.Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def _stored(spark, cache: str, tokenizer: str) -> DataFrame:
    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE_SCHEMA)
    known = rows.where(F.col("tokenizer") == tokenizer)
    return known.groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def fill_cache(documents: DataFrame, vocabulary: str, cache: str, text_column: str = "text") -> None:
    """Encode each distinct text that the cache lacks once and append its count."""
    spark = documents.sparkSession
    tokenizer = version_digest(vocabulary)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    distinct = documents.select(_content(text).alias("content"), text.alias("text")).groupBy("content").agg(F.first("text").alias("text"))
    misses = distinct.join(_stored(spark, cache, tokenizer), "content", "left_anti").select("content", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes = [len(ids) // 4 for ids in encode.packed(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.binary()), pa.array([tokenizer] * len(sizes), pa.string()), pa.array(sizes, pa.int64())],
                    names=CACHE_SCHEMA.names,
                )

    misses.mapInArrow(count, CACHE_SCHEMA).write.mode("append").parquet(cache)


def token_counts(
    documents: DataFrame, vocabulary: str, cache: str | None = None, id_column: str = "doc_id",
    text_column: str = "text", limit: int = 1024,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row.

    `vocabulary` is a file of the tokenizers (.json) or sentencepiece (.model) library.
    `cache` is a folder on shared storage that later calls may use again; by default a
    new one.
    """
    spark = documents.sparkSession
    cache = cache or scratch(spark)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    keyed = materialise(documents.select(
        F.col(id_column).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), _content(text).alias("content")
    ))
    fill_cache(documents, vocabulary, cache, text_column)
    counts = materialise(_stored(spark, cache, version_digest(vocabulary)))  # so that AQE can split a frequent text's rows
    return keyed.join(counts, "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
