"""CSV files with line breaks in quoted texts, read in splits.

Spark reads such a file in one task, as a line break may stand inside a quoted text.
Here the files are read as lines, in Spark's usual splits, twice.

The first pass finds where each split begins: outside or inside a quoted text. A line
leads from either state to one of the two, which two patterns tell. A split's lines
lead from each state to another, too, and chaining these steps along a file gives every
split's first state. Nothing has to be read in order: the pass keeps, per split and
first state, the last state and the pieces of records that cross the split's borders.

The second pass, with the first states known, joins lines to records in every task on
its own. Records that cross a border are put together from the kept pieces. Records are
parsed by Spark's own CSV parser, so fields are read as in a whole file.

Lines end with a line feed, with or without a carriage return before it. A quote inside
an unquoted field is a character like any other. Empty lines are skipped. The first
record of every file is its header. A quoted text that is never closed makes the rest of
its file one record, without the file's last line break; pieces of more than `max_record` characters in total are not joined
but count as one malformed record.

What grows with the input on the driver is one entry per split that begins inside a
quoted text: 800,000 splits of 128 MB at most for 100 TB. `MAX_OPEN` bounds it; larger
splits (`spark.sql.files.maxPartitionBytes`) make it smaller.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_RECORD = 64 << 20
MAX_OPEN = 5_000_000
MALFORMED = "_malformed"

# All repetitions are possessive: the matcher never goes back and never recurses.
# A quote closes its text unless another one follows at once.
_BODY = r'[^"]*+(?:""[^"]*+)*+"[^,]*+'
_FIELD = rf'(?:"{_BODY}|[^",][^,]*+)?+'
#: A line that starts outside quotes and ends outside.
CLOSED_FROM_OUTSIDE = rf"\A{_FIELD}(?:,{_FIELD})*+\z"
#: A line that starts inside quotes and ends outside.
CLOSED_FROM_INSIDE = rf"\A{_BODY}(?:,{_FIELD})*+\z"

_PIECES = T.StructType([
    T.StructField("file", T.LongType()),
    T.StructField("start", T.LongType()),
    # Per first state (0 outside, 1 inside): the last state, whether a record ends in the split, and the pieces.
    T.StructField("last0", T.BooleanType()),
    T.StructField("last1", T.BooleanType()),
    T.StructField("ends0", T.BooleanType()),
    T.StructField("ends1", T.BooleanType()),
    T.StructField("head1", T.StringType()),
    T.StructField("tail0", T.StringType()),
    T.StructField("tail1", T.StringType()),
])
#: Per split: whether it begins inside quotes, in which split its first record then began, and its crossing pieces.
STATES = T.StructType([
    T.StructField("file", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("inside", T.BooleanType()),
    T.StructField("owner", T.LongType()),
    T.StructField("head", T.StringType()),
    T.StructField("tail", T.StringType()),
    T.StructField("header", T.BooleanType()),
])
_STATES_ARROW = pa.schema([
    ("file", pa.int64()), ("start", pa.int64()), ("inside", pa.bool_()), ("owner", pa.int64()), ("head", pa.string()),
    ("tail", pa.string()), ("header", pa.bool_()),
])
_RECORD = T.StructType([T.StructField("record", T.StringType())])


def _without_return(line: Column) -> Column:
    """The text without a carriage return at its end."""
    return F.when(line.endswith("\r"), line.substr(F.lit(1), F.length(line) - 1)).otherwise(line)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the split), outside and inside (a line's last state by its first), part, line."""
    line, at = F.col("value"), F.col("_metadata")
    bare = _without_return(line)
    quoted = F.contains(line, F.lit('"'))
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64(at["file_path"]).alias("file"),
        at["file_block_start"].alias("start"),
        (quoted & ~bare.rlike(CLOSED_FROM_OUTSIDE)).alias("outside"),
        (~quoted | ~bare.rlike(CLOSED_FROM_INSIDE)).alias("inside"),
        (at["file_block_length"] < at["file_size"]).alias("part"),
        line.alias("line"),
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int, bool], np.ndarray, np.ndarray, pa.Array]]:
    """The batch's lines by split (file, start, not the whole file), with their steps from outside and from inside."""
    if not batch.num_rows:
        return
    file, start = (np.asarray(batch.column(k)) for k in (0, 1))
    outside, inside, part = (batch.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in (2, 3, 4))
    cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(file)]):
        yield (int(file[a]), int(start[a]), bool(part[a])), outside[a:b], inside[a:b], batch.column(5).slice(a, b - a)


def states_after(first: bool, outside: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The state after each line. Lines that lead both states to one set it; of those
    after them, the ones that lead each state to the other toggle it."""
    fixed, toggle = outside == inside, outside & ~inside
    n = len(outside)
    last = np.maximum.accumulate(np.where(fixed, np.arange(n), -1))
    toggled = np.cumsum(toggle)
    base = np.where(last >= 0, outside[last], first)
    since = toggled - np.where(last >= 0, toggled[last], 0)
    return base ^ (since % 2 == 1)


def _blank(records: pa.Array) -> pa.Array:
    return pc.or_(pc.equal(records, ""), pc.equal(records, "\r"))


class _Follower:
    """Joins the lines of one split to records, batch after batch."""

    def __init__(self, first: bool):
        self.state = first
        self.in_head = first  # lines that belong to a record of an earlier split
        self.head: list[str] = []
        self.open: list[pa.Array] = []

    def records(self, outside: np.ndarray, inside: np.ndarray, lines: pa.Array, keep_head: bool = False) -> pa.Array:
        """The records that end here; what is left open is held."""
        after = states_after(self.state, outside, inside)
        self.state = bool(after[-1])
        ends = np.flatnonzero(~after) + 1
        if self.in_head:
            upto = ends[0] if len(ends) else len(lines)
            if keep_head:
                self.head += lines.slice(0, upto).to_pylist()
            if not len(ends):
                return lines.slice(0, 0)
            self.in_head, lines, ends = False, lines.slice(upto), ends[1:] - upto
        if not len(ends):
            if len(lines):
                self.open.append(lines)
            return lines.slice(0, 0)
        last, rest = int(ends[-1]), lines.slice(int(ends[-1]))
        whole = lines.slice(0, last)
        if self.open:
            before = pa.concat_arrays(self.open)
            ends, whole, self.open = ends + len(before), pa.concat_arrays([before, whole]), []
        if len(rest):
            self.open.append(rest)
        if len(ends) == len(whole):
            return whole
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(offsets, whole), "\n")

    def tail(self) -> str | None:
        return "\n".join(x for part in self.open for x in part.to_pylist()) if self.open else None


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of _PIECES per split."""
    key, two, ends = None, [], []

    def row() -> pa.RecordBatch:
        outside, inside = two
        return pa.RecordBatch.from_pylist([{
            "file": key[0], "start": key[1], "last0": outside.state, "last1": inside.state, "ends0": ends[0], "ends1": ends[1],
            "head1": "\n".join(inside.head), "tail0": outside.tail(), "tail1": inside.tail(),
        }], _PIECES_ARROW)

    for batch in batches:
        for split, outside, inside, lines in _runs(batch):
            if split != key:
                if key is not None:
                    yield row()
                key, two, ends = split, [_Follower(False), _Follower(True)], [False, False]
            for which, follower in enumerate(two):
                records = follower.records(outside, inside, lines, keep_head=which == 1)
                ends[which] |= bool(len(records)) and not pc.all(_blank(records)).as_py()
    if key is not None:
        yield row()


_PIECES_ARROW = pa.schema([
    ("file", pa.int64()), ("start", pa.int64()), ("last0", pa.bool_()), ("last1", pa.bool_()), ("ends0", pa.bool_()),
    ("ends1", pa.bool_()), ("head1", pa.string()), ("tail0", pa.string()), ("tail1", pa.string()),
])


def _chain(pieces: pa.Table) -> pa.Table:
    """The states of one file's splits."""
    inside, owner, rows = False, None, []
    for p in pieces.sort_by("start").to_pylist():
        tail = p["tail1"] if inside else p["tail0"]
        rows.append({
            "file": p["file"], "start": p["start"], "inside": inside, "owner": owner, "head": p["head1"] if inside else None, "tail": tail,
            # The header is still open at the end of the first split if no record ended in it.
            "header": p["start"] == 0 and not p["ends0"],
        })
        inside = p["last1"] if inside else p["last0"]
        owner = (p["start"] if tail is not None else owner) if inside else None
    return pa.Table.from_pylist(rows, _STATES_ARROW)


@dataclass(frozen=True)
class Header:
    """The names that every file must begin with."""

    names: tuple[str, ...]

    def check(self, record: str) -> None:
        found = next(csv.reader([record.rstrip("\r")]), [])
        if [n.lower() for n in found] != [n.lower() for n in self.names]:
            raise ValueError(f"the header of a file names {found}, not {list(self.names)}")


def _joiner(opened: dict[int, np.ndarray], header: Header) -> Callable:
    """The second pass. `opened`: per file, ascending, the splits that begin inside quotes."""

    def begins_inside(split: tuple[int, int, bool]) -> bool:
        starts = opened.get(split[0])
        if starts is None:
            return False
        at = np.searchsorted(starts, split[1])
        return at < len(starts) and starts[at] == split[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, follower, headed, part = None, _Follower(False), True, True

        def left() -> pa.Array:
            """What a whole file left open; of a split the first pass has kept it."""
            text = None if part else follower.tail()
            if not headed and text is not None:
                header.check(text)
                text = None
            return pa.array([] if text is None else [text], pa.string())

        for batch in batches:
            out = []
            for split, outside, inside, lines in _runs(batch):
                if split != key:
                    out.append(left())
                    key, follower, headed, part = split, _Follower(begins_inside(split)), split[1] != 0, split[2]
                found = follower.records(outside, inside, lines)
                found = found.filter(pc.invert(_blank(found)))
                if not headed and len(found):
                    header.check(found[0].as_py())
                    headed, found = True, found.slice(1)
                out.append(found)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(out)], names=["record"])
        yield pa.RecordBatch.from_arrays([left()], names=["record"])

    return run


def split_states(spark: SparkSession, path: str) -> DataFrame:
    """A row of STATES per split of the files that have more than one."""
    lines = _lines(spark, path).where("part")
    return lines.mapInArrow(_summarise, _PIECES).groupBy("file").applyInArrow(_chain, STATES)


def _crossing_records(states: DataFrame, header: Header, max_record: int) -> DataFrame:
    """The records that cross a border, from their pieces; null for one that is too long."""
    heads = states.where("inside").select("file", F.col("owner").alias("began"), "start", F.col("head").alias("piece"), F.lit(False).alias("header"))
    tails = states.where("tail IS NOT NULL").select("file", F.col("start").alias("began"), "start", F.col("tail").alias("piece"), "header")
    pieces = heads.unionByName(tails)
    sizes = pieces.groupBy("file", "began").agg(F.sum(F.length("piece")).alias("size"), F.bool_or("header").alias("is_header"))
    # Of a record that is too long no piece is collected.
    piece = F.when(F.col("size") <= max_record, F.struct("start", "piece"))
    joined = pieces.join(sizes, ["file", "began"]).groupBy("file", "began").agg(
        F.array_sort(F.collect_list(piece)).alias("pieces"), F.first("is_header").alias("is_header")
    )
    record = F.when(F.size("pieces") > 0, F.array_join(F.col("pieces")["piece"], "\n"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).filter(batch.column(1)).to_pylist():
                header.check(text or "")
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pc.invert(batch.column(1)))], names=["record"])

    return joined.select(record.alias("record"), "is_header").mapInArrow(check, _RECORD)


def records(spark: SparkSession, path: str, names: tuple[str, ...], states: DataFrame, max_record: int = MAX_RECORD) -> DataFrame:
    """One column, `record`: the text of every record after its file's header.

    `states` is the written table of `split_states`.
    """
    header = Header(tuple(names))
    inside = states.where("inside").select("file", "start")
    known = states.agg(F.count("*"), F.count_if("inside")).first()
    if known[1] > MAX_OPEN:
        raise ValueError(f"{known[1]} splits begin inside quotes; read larger splits (spark.sql.files.maxPartitionBytes)")
    opened: dict[int, list[int]] = {}
    for file, start in inside.orderBy("file", "start").collect():
        opened.setdefault(file, []).append(start)
    whole = _lines(spark, path).mapInArrow(_joiner({f: np.array(s) for f, s in opened.items()}, header), _RECORD)
    return whole.unionByName(_crossing_records(states, header, max_record)) if known[0] else whole


def parse(found: DataFrame, names: tuple[str, ...], keep_malformed: bool = False) -> DataFrame:
    """Records as text columns. Those with another number of fields are left out, or kept
    with their text as the column `_malformed` (null for good ones)."""
    schema = ", ".join(f"`{name.replace('`', '``')}` STRING" for name in [*names, MALFORMED])
    options = {
        "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED, "maxCharsPerColumn": "-1",
    }
    parsed = F.from_csv(F.coalesce(_without_return(F.col("record")), F.lit("")), schema, options)
    # As in `cleaning.typed`: what comes out of an array is parsed once.
    rows = found.select(F.inline(F.array(parsed)), F.col("record").isNull().alias("_too_long"))
    bad = F.coalesce(F.col(MALFORMED), F.when(F.col("_too_long"), F.lit("")))
    rows = rows.withColumn(MALFORMED, bad).drop("_too_long")
    return rows if keep_malformed else rows.where(F.col(MALFORMED).isNull()).drop(MALFORMED)
