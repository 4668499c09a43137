"""Fill-in-the-middle: texts cut into prefix, middle and suffix, and put in another order.

A text is cut into units: code points, words (a word with the white space after it) or
lines. Two cuts fall after any of 0..n units, drawn from the sha256 of the seed and the
id, so equal ids are cut alike if their texts have the same number of units. The form is
`plain` (the text as it is), `psm` (`<P>`prefix`<S>`suffix`<M>`middle) or `spm`
(`<S>`suffix`<P>`prefix`<M>`middle). A text that is empty or holds one of the marks stays
plain, so marks are never ambiguous and `restore` gives every text back exactly.

The work is done on Arrow arrays: units as a list array, flattened with their parents,
ordinals from the list offsets, a filter by role, lists built again from the filtered
units, and pieces joined per batch. Runs of about WINDOW bytes of a batch go through
this at a time; a longer text is cut into several lists whose pieces are joined, so
memory does not grow with a text's units.

A null text is an empty one; a null id is hashed as an empty string. Repeated rows are
cut alike and all kept; an empty table gives no rows. Only the id and text columns are
read, so other columns clash with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.llm.wordhash import SPACES, slices, text_bytes

WINDOW = 1 << 20
MARKS = ("<P>", "<S>", "<M>")
PREFIX, MIDDLE, SUFFIX = range(3)

FORMED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
])


def _unit_starts(data: np.ndarray, offsets: np.ndarray, unit: str) -> np.ndarray:
    """Byte places where units begin; every text that is not empty begins one."""
    if unit == "char":
        starts = (data & 0xC0) != 0x80
    elif unit == "word":
        space = SPACES[data]
        starts = np.zeros(len(data), bool)
        starts[1:] = ~space[1:] & space[:-1]
    elif unit == "line":
        starts = np.zeros(len(data), bool)
        starts[1:] = data[:-1] == 10
    else:
        raise ValueError(f"no such unit: {unit}")
    starts[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(starts)


def _windows(bounds: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of units of about WINDOW bytes, as first unit and end."""
    at = 0
    while at < len(starts):
        end = int(np.searchsorted(starts, starts[at] + WINDOW, "right"))
        yield at, max(at + 1, end)
        at = max(at + 1, end)


def cut(texts: pa.Array, first: np.ndarray, second: np.ndarray, unit: str = "char") -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """Units per text, places of the two cuts, and the three pieces of every text.

    `first` and `second` are unsigned numbers per text; each cut is the number modulo
    (units + 1), the smaller one ends the prefix.
    """
    data, offsets = text_bytes(texts)
    starts = _unit_starts(data, offsets, unit)
    bounds = np.searchsorted(starts, offsets)  # the first unit of every text
    n = np.diff(bounds)
    low, high = np.minimum(first % (n + 1), second % (n + 1)), np.maximum(first % (n + 1), second % (n + 1))
    owners: list[list[np.ndarray]] = [[], [], []]
    parts: list[list[pa.Array]] = [[], [], []]
    for a, b in _windows(bounds, starts):
        own = np.append(starts[a:b], starts[b] if b < len(starts) else len(data))
        units = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(own - own[0]), pa.py_buffer(data[own[0] : own[-1]]))
        inside = (bounds[:-1] < b) & (bounds[1:] > a)
        text = np.flatnonzero(inside)
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(np.maximum(bounds[text], a), b) - a), units)
        parent, flat = text[pc.list_parent_indices(lists).to_numpy()], pc.list_flatten(lists)
        ordinal = np.arange(a, b) - bounds[parent]
        role = np.where(ordinal < low[parent], PREFIX, np.where(ordinal < high[parent], MIDDLE, SUFFIX))
        for which in (PREFIX, MIDDLE, SUFFIX):
            mask = role == which
            if not mask.any():
                continue
            kept, of = pc.filter(flat, pa.array(mask)), parent[mask]
            begins = np.flatnonzero(np.diff(of, prepend=-1))
            again = pa.LargeListArray.from_arrays(pa.array(np.append(begins, len(of))), kept)
            owners[which].append(of[begins])
            parts[which].append(pc.binary_join(again, pa.scalar("", pa.large_string())))
    pieces = []
    for which in (PREFIX, MIDDLE, SUFFIX):
        of = np.concatenate([np.empty(0, np.int64), *owners[which]])
        all_parts = pa.concat_arrays([pa.array([], pa.large_string()), *parts[which]])
        lists = pa.LargeListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(texts) + 1))), all_parts)
        pieces.append(pc.binary_join(lists, pa.scalar("", pa.large_string())))
    return n, np.stack([low, high]), pieces


def _joined(*pieces: pa.Array | str) -> pa.Array:
    strings = [pa.scalar(p, pa.large_string()) if isinstance(p, str) else p for p in pieces]
    return pc.binary_join_element_wise(*strings, pa.scalar("", pa.large_string()))


def _draw(digest: Column, group: int) -> Column:
    """The 8-digit group of a hexadecimal digest as an unsigned integer."""
    return F.conv(F.substring(digest, 1 + 8 * group, 8), 16, 10).cast("long")


def transform(
    documents: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20, unit: str = "char",
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output per row of `documents`.

    n counts units; prefix_chars and middle_chars count code points and are null for plain
    texts. Of 100 texts about 100 - `plain_from` stay plain, and of the others about
    `spm_below` in 100 put the suffix first.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))).cast("binary"), 256)
    drawn = documents.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"), digest.alias("_digest")).select(
        "doc_id", "text", *[_draw(F.col("_digest"), k).alias(f"h{k + 1}") for k in range(4)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(1), WINDOW):
                ids, texts, *h = batch.slice(start, stop - start).columns
                texts = texts.cast(pa.large_string())
                h1, h2, h3, h4 = (np.asarray(x) for x in h)
                n, _, (prefix, middle, suffix) = cut(texts, h1, h2, unit)
                marked = pc.equal(pc.binary_length(texts), 0)
                for mark in MARKS:
                    marked = pc.or_(marked, pc.match_substring(texts, mark))
                plain = pc.or_(marked, pa.array(h3 % 100 >= plain_from))
                form = pc.if_else(plain, "plain", pc.if_else(pa.array(h4 % 100 < spm_below), "spm", "psm"))
                psm = _joined(MARKS[0], prefix, MARKS[1], suffix, MARKS[2], middle)
                spm = _joined(MARKS[1], suffix, MARKS[0], prefix, MARKS[2], middle)
                output = pc.if_else(plain, texts, pc.if_else(pc.equal(form, "spm"), spm, psm))
                none = pa.scalar(None, pa.int64())
                lengths = [pc.if_else(plain, none, pc.utf8_length(piece).cast(pa.int64())) for piece in (prefix, middle)]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n), form.cast(pa.string()), *lengths, output.cast(pa.string())], names=FORMED.names
                )

    return drawn.mapInArrow(run, FORMED)


def _between(texts: pa.Array, mark: str) -> tuple[pa.Array, pa.Array]:
    """What stands before and after the mark, which every text holds once."""
    halves = pc.split_pattern(texts, mark, max_splits=1)
    return pc.list_element(halves, 0), pc.list_element(halves, 1)


def restore(formed: DataFrame) -> DataFrame:
    """Adds `restored`, the text rebuilt from `form` and `output`; other columns stay."""
    schema = T.StructType([f for f in formed.schema if f.name != "restored"] + [T.StructField("restored", T.StringType())])
    columns = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column("output"), WINDOW):
                part = batch.slice(start, stop - start)
                output, form = part.column("output").cast(pa.large_string()), part.column("form")
                restored = output
                for name, (one, two) in (("psm", MARKS[:2]), ("spm", MARKS[1::-1])):
                    own = pc.equal(form, name)
                    if not pc.any(own).as_py():
                        continue
                    body = pc.utf8_slice_codeunits(output.filter(own), len(one))
                    before, rest = _between(body, two)
                    after, middle = _between(rest, MARKS[2])
                    whole = _joined(before, middle, after) if name == "psm" else _joined(after, middle, before)
                    restored = pc.replace_with_mask(restored, own, whole)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in columns] + [restored.cast(pa.string())], names=schema.names)

    return formed.select(*columns).mapInArrow(run, schema)
