"""Substring search through an index of trigrams.

The index holds the rows it was built of, in parts of about PART_ROWS rows and blocks of
parts, and posting lists: for every trigram (three bytes of the lower-cased text) and part
the ids of the rows that have it. A search intersects, part by part, the lists of the
phrase's rarest trigrams and reads the rows of only the parts and blocks that are left.
What it returns are candidates: they hold every row with the phrase, and the caller's own
predicate decides about each. A phrase of fewer than three bytes has no trigram, so all
rows are candidates.

Parts are dealt to tasks one by one, not by blocks, so what a task reads stays as large as
a few parts however many rows there are. A list is at most a part long, so a trigram that a
third of all texts have spreads over all parts. The lists of a few parts each lie in a file,
ordered by column and trigram, in small row groups: no task has all lists of a frequent
trigram, and a search reads few row groups of a file. A list may lie in
pieces, one for every few megabytes of text, which a search puts together: parts of long texts
are dealt to several files. On the driver are the
phrase's trigrams with their counts, and the numbers of parts that a search is left with, up to MANY.

An index is built in three writes: the rows as they come, the rows dealt by part, and the
lists. A task makes the lists of its parts from their texts, so lists are never shuffled, and
what a write has shuffled is removed with its end.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.sources.files import materialise, remove, shuffles_removed

PART_ROWS, PARTS_A_BLOCK = 1 << 16, 64
#: Parts whose lists go into one file, and bytes of their texts, on the average; bytes of a row group of lists.
PARTS_A_FILE, TEXT_A_FILE, LIST_GROUP = 4, 32 << 20, 8 << 20
#: Trigrams of a phrase that are looked up, the rarest first.
RAREST = 4
#: Parts beyond which a search names no single ones any more, but reads all rows of the candidates' join.
MANY = 10_000
#: Bytes of text, and texts, whose lists are made at once.
_SLICE, _TEXTS = 4 << 20, 1 << 20
POSTINGS = T.StructType([
    T.StructField("column", T.IntegerType()), T.StructField("gram", T.IntegerType()), T.StructField("part", T.IntegerType()),
    T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("n", T.IntegerType()),
])


def grams_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and trigram of every place in the texts; null has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]].astype(np.int32)
    if len(data) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    codes = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    inside = text[:-2] == text[2:]
    return text[:-2][inside], codes[inside]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of about _SLICE bytes, one text at least."""
    sizes = np.cumsum([0, *(x or 0 for x in pc.binary_length(texts).to_pylist())])
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(sizes, sizes[start] + _SLICE, "right")) - 1)
        yield start, stop
        start = stop


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together, up to about _SLICE bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= _SLICE or sum(b.num_rows for b in held) >= _TEXTS:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _lists(column: int, part: np.ndarray, ids: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
    """A row of POSTINGS per trigram and part of a run of texts, which come by part and id."""
    text, gram = grams_of(texts)
    bits = len(texts).bit_length()
    numbers, rank = np.unique(part, return_inverse=True)
    key = np.unique((rank[text].astype(np.int64) << 24 | gram) << bits | text)
    text = key & ((1 << bits) - 1)
    key >>= bits
    owners = ids[text]
    new_list = np.ones(len(key), bool)
    new_list[1:] = key[1:] != key[:-1]
    new = new_list.copy()
    new[1:] |= owners[1:] != owners[:-1]
    key, owners, new_list = key[new], owners[new], new_list[new]
    at = np.append(np.flatnonzero(new_list), len(owners))
    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(owners, pa.int64()))
    key = key[at[:-1]]
    values = (np.full(len(key), column), key & 0xFFFFFF, numbers[key >> 24])
    return pa.RecordBatch.from_arrays(
        [*(pa.array(x, pa.int32()) for x in values), lists, pa.array(np.diff(at), pa.int32())], names=POSTINGS.names
    )


@dataclass(frozen=True)
class TrigramIndex:
    """The index under `folder`."""

    spark: SparkSession
    folder: str
    columns: tuple[str, ...]
    schema: T.StructType  # of the stored rows

    @property
    def rows(self) -> DataFrame:
        """With the columns `_block` and `_part`."""
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/rows")

    def _all(self) -> DataFrame:
        return self.rows.drop("_block", "_part")

    def candidates(self, column: str, phrase: str) -> DataFrame:
        """Rows that may hold the phrase, in any case, in the column: all that do, and few others."""
        _, grams = grams_of(pa.array([phrase.lower()]))
        if not len(grams):
            return self._all()
        postings = self.spark.read.schema(POSTINGS).parquet(f"{self.folder}/postings").where(F.col("column") == self.columns.index(column))
        wanted = np.unique(grams).tolist()
        counts = postings.where(F.col("gram").isin(wanted)).groupBy("gram").agg(F.sum("n").alias("n"))
        counts = sorted((r["n"], r["gram"]) for r in counts.collect())
        if len(counts) < len(wanted):
            return self._all().limit(0)
        rarest = [gram for _, gram in counts[:RAREST]]
        whole = postings.where(F.col("gram").isin(rarest)).groupBy("part", "gram").agg(F.flatten(F.collect_list("ids")).alias("ids"))
        lists = whole.groupBy("part").agg(F.collect_list("ids").alias("lists"))
        lists = lists.where(F.size("lists") == len(rarest))
        common = F.aggregate("lists", F.get("lists", F.lit(0)), F.array_intersect)
        with shuffles_removed(self.spark):
            found = materialise(lists.select("part", F.explode(common).alias("_id")), f"{self.folder}/found/{uuid.uuid4().hex}")
        parts = [r["part"] for r in found.select("part").distinct().limit(MANY + 1).collect()]
        rows = self.rows
        if len(parts) <= MANY:
            rows = rows.where(F.col("_block").isin(sorted({p // PARTS_A_BLOCK for p in parts})) & F.col("_part").isin(parts))
        same = (F.col("_part") == F.col("part")) & (F.col("id") == F.col("_id"))
        return rows.join(found, same, "left_semi").drop("_block", "_part")


def build(rows: DataFrame, columns: tuple[str, ...], folder: str, part_rows: int = PART_ROWS) -> TrigramIndex:
    """Write the rows (with a whole-number `id`, as in the clean table; rows without one are
    left out) and the posting lists of the text columns."""
    spark = rows.sparkSession
    with shuffles_removed(spark):
        made = materialise(rows.where(F.col("id").isNotNull()), f"{folder}/made")
        count, size = made.agg(F.count("*"), F.sum(sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in columns))).first()
        parts = max(1, -(-count // part_rows))
        part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
        placed = made.withColumn("_part", part).withColumn("_block", F.floor(F.col("_part") / PARTS_A_BLOCK).cast("int"))
        placed = placed.repartition(parts, "_part").sortWithinPartitions("_block", "_part", "id")
        placed.write.partitionBy("_block").option("compression", "zstd").parquet(f"{folder}/rows")
        remove(spark, f"{folder}/made")
        stored = spark.read.schema(placed.schema).parquet(f"{folder}/rows").select("_part", F.col("id").cast("long"), *[F.lower(c).alias(c) for c in columns])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _joined(batches):
                part, ids = np.asarray(table.column(0)), np.asarray(table.column(1))
                for number in range(len(columns)):
                    texts = pa.concat_arrays(table.column(2 + number).chunks) if table.num_rows else pa.array([], pa.string())
                    for a, b in _slices(texts):
                        yield _lists(number, part[a:b], ids[a:b], texts.slice(a, b - a))

        share = max(1, (size or 0) // parts)
        together, pieces = min(PARTS_A_FILE, max(1, TEXT_A_FILE // share)), -(-share // TEXT_A_FILE)
        file = F.floor(F.col("_part") / together) * pieces + F.pmod(F.xxhash64("id", F.lit(pieces)), F.lit(pieces))
        dealt = stored.repartitionById(-(-parts // together) * pieces, file.cast("int")).sortWithinPartitions("_part", "id")
        lists = dealt.mapInArrow(run, POSTINGS).sortWithinPartitions("column", "gram", "part")
        lists.write.options(**{"compression": "zstd", "parquet.block.size": LIST_GROUP}).parquet(f"{folder}/postings")
    return TrigramIndex(spark, folder, tuple(columns), placed.schema)
