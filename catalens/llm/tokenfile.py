"""Token ids in files of fixed-width bit-packed integers.

A file holds the ids of whole documents, one after the other, each id in the fewest
bits that the vocabulary needs. Ids come in blocks of BLOCK; 64 ids of w bits fill w
64-bit words, so numpy packs and unpacks a block in 64 passes, and any id can be found
without reading what comes before it:

  magic 8 bytes
  blocks, each of ceil(ids * width / 8) bytes
  width, ids per block, blocks, documents, ids: 5 x uint64
  offset of every block: uint64 x blocks
  document ids: int64 x documents; null flags: uint8 x documents
  first id of every document, and the end: uint64 x (documents + 1)
  length of the parts after the blocks: uint64

All numbers are little-endian. Documents go to ranges of ascending doc_id (nulls
first, ties by a hash of the text, then the text), so file after file the ids follow the
documents' order, and rows of one id spread over ranges; the manifest lists the files with
their counts. A file closes by ids or by documents, so that the offsets a task holds, 17
bytes a document, are bounded. Null and empty texts give only the end id.
An empty table gives no files. Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.llm.store import ENTRY, ENTRY_ARROW, commit, open_folder, read_manifest, scratch, temporary_name
from catalens.llm.vocab import encoder

MAGIC = b"TOKBITS1"
BLOCK = 1 << 16
#: A file closes after the document that brings it to so many ids or documents.
FILE_IDS, FILE_DOCS = 1 << 27, 1 << 20


def width_of(vocabulary_size: int) -> int:
    return max(1, int(vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids as consecutive little-endian fields of `width` bits (1 to 32)."""
    groups = -(-len(ids) // 64)
    padded = np.zeros(groups * 64, np.uint64)
    padded[: len(ids)] = ids
    lanes = np.ascontiguousarray(padded.reshape(groups, 64).T)
    words = np.zeros((width, groups), np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * width, 64)
        words[word] |= lanes[lane] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[lane] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").tobytes()[: -(-len(ids) * width // 8)]


def unpack(data: bytes, count: int, width: int) -> np.ndarray:
    groups = -(-count // 64)
    whole = data + bytes(groups * width * 8 - len(data))
    words = np.ascontiguousarray(np.frombuffer(whole, "<u8").reshape(groups, width).T)
    mask, lanes = np.uint64((1 << width) - 1), np.empty((64, groups), np.uint32)
    for lane in range(64):
        word, shift = divmod(lane * width, 64)
        value = words[word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[word + 1] << np.uint64(64 - shift)
        lanes[lane] = value & mask
    return np.ascontiguousarray(lanes.T).reshape(-1)[:count]


class Writer:
    """Streams documents into one file; memory holds a block and the documents' offsets."""

    def __init__(self, store, path: str, width: int):
        self.out, self.width = store.open_output_stream(path), width
        self.out.write(MAGIC)
        self.at = len(MAGIC)
        self.rest: list[np.ndarray] = []
        self.waiting = self.ids = 0
        self.offsets, self.docs, self.firsts = array("q"), array("q"), array("q")
        self.nulls = bytearray()

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.firsts.append(self.ids)
        self.ids += len(ids)
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            held, at = np.concatenate(self.rest), 0
            while len(held) - at >= BLOCK:
                self._block(held[at : at + BLOCK])
                at += BLOCK
            self.rest, self.waiting = [held[at:]], len(held) - at

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> int:
        if self.waiting:
            self._block(np.concatenate(self.rest))
        self.firsts.append(self.ids)
        length = 0
        counts = np.array([self.width, BLOCK, len(self.offsets), len(self.docs), self.ids])
        for part in (counts, self.offsets, self.docs, self.nulls, self.firsts):
            data = bytes(part) if part is self.nulls else np.asarray(part).astype("<i8").tobytes()
            self.out.write(data)
            length += len(data)
        self.out.write(np.array([length], "<u8").tobytes())
        self.out.close()
        return self.at + length + 8


class Reader:
    """Random access to the ids of one file."""

    def __init__(self, store, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        (length,) = np.frombuffer(self.file.read_at(8, size - 8), "<u8")
        tail, at = self.file.read_at(int(length), size - 8 - int(length)), 40
        if self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is not a token file")
        self.width, self.block, blocks, docs, self.ids = (int(x) for x in np.frombuffer(tail, "<u8", 5))
        self.offsets = np.frombuffer(tail, "<u8", blocks, at).astype(np.int64)
        at += 8 * blocks
        nulls = np.frombuffer(tail, np.uint8, docs, at + 8 * docs)
        self.docs = pa.array(np.frombuffer(tail, "<i8", docs, at), pa.int64(), mask=nulls.astype(bool))
        self.firsts = np.frombuffer(tail, "<u8", docs + 1, at + 9 * docs).astype(np.int64)
        self._held: tuple[int, np.ndarray] = (-1, np.empty(0, np.uint32))

    def _ids_of_block(self, number: int) -> np.ndarray:
        if self._held[0] != number:
            count = min(self.block, self.ids - number * self.block)
            data = self.file.read_at(-(-count * self.width // 8), int(self.offsets[number]))
            self._held = number, unpack(data, count, self.width)
        return self._held[1]

    def read(self, first: int, end: int) -> np.ndarray:
        """ids first to end - 1 of the file; only their blocks are read."""
        parts = []
        while first < end:
            number = first // self.block
            stop = min(end, (number + 1) * self.block)
            parts.append(self._ids_of_block(number)[first - number * self.block : stop - number * self.block])
            first = stop
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def document(self, index: int) -> np.ndarray:
        return self.read(int(self.firsts[index]), int(self.firsts[index + 1]))


def write_tokens(
    documents: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS
) -> str:
    """Encode every text, append the end id, write the files; returns their folder."""
    spark = documents.sparkSession
    folder = folder or scratch(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    ordered = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        width = width_of(max(encode.size, end_id + 1))
        store, base = open_folder(folder)
        store.create_dir(f"{base}/temporary", recursive=True)
        part, seq, out, name = TaskContext.get().partitionId(), 0, None, ""

        def entry() -> pa.RecordBatch:
            row = {
                "shard": part, "seq": seq, "name": f"tokens-{part:06d}-{seq:04d}.bin", "temporary": name,
                "n_bytes": out.close(), "n_records": len(out.docs), "n_items": out.ids,
            }
            return pa.RecordBatch.from_pylist([row], ENTRY_ARROW)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                for doc_id, ids in zip(rows.column(0).to_pylist(), encode.packed(rows.column(1).to_pylist())):
                    if out is None:
                        name = temporary_name()
                        out = Writer(store, f"{base}/{name}", width)
                    out.add(doc_id, np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id)))
                    if out.ids >= file_ids or len(out.docs) >= file_docs:
                        yield entry()
                        seq, out = seq + 1, None
        if out is not None:
            yield entry()

    commit(ordered.mapInArrow(write, ENTRY), folder)
    return folder


READ = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
])


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: where its ids begin among all ids, how many, their crc32."""
    manifest = read_manifest(spark, folder)
    before = Window.orderBy("shard", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.withColumn("first", F.coalesce(F.sum("n_items").over(before), F.lit(0))).select("name", "first")
    files = files.repartition(max(1, spark.sparkContext.defaultParallelism * 2), "name")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(folder)
        for batch in batches:
            for name, first in zip(*(column.to_pylist() for column in batch.columns)):
                file = Reader(store, f"{base}/{name}")
                for at in range(0, len(file.docs), 4096):
                    stop = min(at + 4096, len(file.docs))
                    crcs = [zlib.crc32(file.document(i).astype("<u4").tobytes()) for i in range(at, stop)]
                    starts = file.firsts[at : stop + 1]
                    yield pa.RecordBatch.from_arrays(
                        [file.docs.slice(at, stop - at), pa.array(starts[:-1] + first), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())],
                        names=READ.names,
                    )

    return files.mapInArrow(read, READ)
