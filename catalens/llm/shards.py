"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Rows are hashed into a fixed number of slots (thousands). Rows, bytes per slot are
summed by Spark; only the slot table, one row per slot, reaches the driver. The map
gives each slot to a shard so that the shards' bytes are near equal. A new version
edits the last one: it moves as few slots as the new sizes or shard count ask for.

A row's size is the UTF-8 bytes of its text (null: none) plus 1. Rows equal in id and
text share a slot, others spread however often their id or text repeats; a null id is
a value like any other. Ties go by slot number. An empty table gives slots of 0 bytes.
`shard_documents` reads only the id and text columns. `assign_shards` keeps all columns;
those that are called like the two it adds come out with `input_` before their name.

With a folder of maps, a placement reads the newest version there, edits it for the sizes
it finds, and stores and reads back the next version, so a later run moves few rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalens.llm.store import materialise, scratch
from catalens.sources.files import exists

SLOTS = 4096
SHARDS = 16


@dataclass(frozen=True)
class SlotMap:
    version: int
    shards: int
    owner: tuple[int, ...]  # shard per slot

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.shards, slot, shard) for slot, shard in enumerate(self.owner)]
        return spark.createDataFrame(rows, "version int, shards int, virtual_slot int, shard int")


def slotted(rows: DataFrame, id_column: str = "doc_id", text_column: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot per row."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    bare = rows.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    return bare.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(slots)).cast("int"))


def slot_sizes(slotted_rows: DataFrame, slots: int = SLOTS) -> list[tuple[int, int]]:
    """(bytes, rows) of every slot; the table that reaches the driver has one row per slot."""
    found = slotted_rows.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect()
    table = {slot: (size, count) for slot, size, count in found}
    return [table.get(slot, (0, 0)) for slot in range(slots)]


def first_map(sizes: list[int], shards: int = SHARDS) -> SlotMap:
    """Largest slot first, each to the shard with the fewest bytes."""
    owner, heap = [0] * len(sizes), [(0, shard) for shard in range(shards)]
    for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
        load, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (load + sizes[slot], shard))
    return SlotMap(1, shards, tuple(owner))


def rebalance(old: SlotMap, sizes: list[int], shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
    """The next version: slots move, one at a time, from the fullest shard that has one that
    narrows the gap to the emptiest, while a shard is off the mean by more than `tolerance`.

    Shards beyond the new count lose all their slots first. The map of equal sizes and
    shard count comes back unchanged but for its version.
    """
    shards = shards or old.shards
    if len(sizes) != len(old.owner):
        raise ValueError(f"the map has {len(old.owner)} slots, not {len(sizes)}")
    owner, load = list(old.owner), [0] * max(shards, old.shards)
    held: list[list[int]] = [[] for _ in load]
    for slot, shard in enumerate(owner):
        load[shard] += sizes[slot]
        held[shard].append(slot)

    def move(slot: int, to: int) -> None:
        held[owner[slot]].remove(slot)
        load[owner[slot]] -= sizes[slot]
        owner[slot] = to
        held[to].append(slot)
        load[to] += sizes[slot]

    for gone in range(shards, old.shards):
        for slot in sorted(held[gone], key=lambda s: (-sizes[s], s)):
            move(slot, min(range(shards), key=lambda x: (load[x], x)))
    mean = sum(sizes) / shards
    for _ in range(len(sizes) * 2):
        by_load = sorted(range(shards), key=lambda x: (-load[x], x))
        low = min(range(shards), key=lambda x: (load[x], x))
        if max(load[by_load[0]] - mean, mean - load[low]) <= tolerance * mean:
            break
        # The fullest shard may hold one large slot that cannot help.
        for high in by_load:
            gap = load[high] - load[low]
            fits = [s for s in held[high] if 0 < sizes[s] < gap]
            if fits:
                move(min(fits, key=lambda s: (abs(gap - 2 * sizes[s]), s)), low)
                break
        else:
            break
    return SlotMap(old.version + 1, shards, tuple(owner))


def next_map(spark: SparkSession, folder: str, sizes: list[int], shards: int) -> SlotMap:
    """The stored map for these sizes: the first version, or the newest one rebalanced."""
    newest = newest_version(spark, folder)
    if newest:
        made = rebalance(read_map(spark, folder, newest), sizes, shards)
    else:
        made = first_map(sizes, shards)
    write_map(spark, made, folder)
    return read_map(spark, folder, made.version)


def newest_version(spark: SparkSession, folder: str) -> int:
    """0 where no map is stored."""
    if not exists(spark, folder):
        return 0
    return spark.read.schema("version int").parquet(folder).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def write_map(spark: SparkSession, slot_map: SlotMap, folder: str) -> None:
    """One folder per version; a version is never overwritten."""
    slot_map.frame(spark).drop("version").coalesce(1).write.parquet(f"{folder}/version={slot_map.version}")


def read_map(spark: SparkSession, folder: str, version: int) -> SlotMap:
    rows = spark.read.parquet(f"{folder}/version={version}").orderBy("virtual_slot").collect()
    return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def place(slotted_rows: DataFrame, slot_map: SlotMap, counts: list[int]) -> DataFrame:
    """Adds the shard and the row's place in it: gapless from 0 in every shard, slot by
    slot, within a slot by id, checksum and size."""
    start, at = {}, [0] * slot_map.shards
    for slot, shard in enumerate(slot_map.owner):
        start[slot] = at[shard]
        at[shard] += counts[slot]
    spark = slotted_rows.sparkSession
    table = spark.createDataFrame(
        [(slot, shard, start[slot]) for slot, shard in enumerate(slot_map.owner)], "virtual_slot int, shard int, first long"
    )
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        slotted_rows.join(F.broadcast(table), "virtual_slot")  # one row per slot
        .withColumn("slot", F.col("first") + F.row_number().over(inside) - 1)
        .drop("first")
    )


def shard_documents(documents: DataFrame, shards: int = SHARDS, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot of every row of `documents`.

    `maps` is the folder of the versioned maps, by default a new one.
    """
    rows = materialise(slotted(documents, slots=slots))
    sizes = slot_sizes(rows, slots)
    slot_map = next_map(rows.sparkSession, maps or scratch(rows.sparkSession), [size for size, _ in sizes], shards)
    return place(rows, slot_map, [count for _, count in sizes])


def assign_shards(
    documents: DataFrame, shards: int = SHARDS, slots: int = SLOTS, maps: str | None = None
) -> tuple[DataFrame, SlotMap]:
    """All rows and columns of `documents` with `shard` and `virtual_slot`, and the stored map."""
    spark = documents.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = (F.octet_length(text) + F.lit(1)).cast("long")
    key = F.xxhash64("doc_id", size, F.crc32(F.encode(text, "UTF-8")))
    rows = documents.withColumnsRenamed(_apart(documents.columns, ("shard", "virtual_slot")))
    rows = rows.withColumn("virtual_slot", F.pmod(key, F.lit(slots)).cast("int"))
    sizes = [size for size, _ in slot_sizes(slotted(documents, slots=slots), slots)]
    slot_map = next_map(spark, maps or scratch(spark), sizes, shards)
    table = F.broadcast(slot_map.frame(spark).select("virtual_slot", "shard"))  # one row per slot
    return rows.join(table, "virtual_slot"), slot_map


def _apart(columns: list[str], reserved: tuple[str, ...]) -> dict[str, str]:
    """New names for columns that clash with reserved ones, whatever their case."""
    taken, names = {c.lower() for c in columns} | set(reserved), {}
    for column in columns:
        if column.lower() in reserved:
            name = f"input_{column}"
            while name.lower() in taken:
                name = f"input_{name}"
            taken.add(name.lower())
            names[column] = name
    return names
