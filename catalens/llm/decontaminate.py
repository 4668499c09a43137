"""Training documents that hold test items, exact or edited.

Words are runs of letters, marks and digits, lower-cased; in scripts written without
blanks (Han, kana, Thai, Lao, Khmer, Burmese) every character is a word. Punctuation and
symbols of all scripts part words. The 3-word runs of the items are
counted over all documents; of each item the rarer three quarters (by documents and
items that hold them), and all that stand in FEW documents or fewer, are its seeds, so an
item's own frequent copies don't cost it its seeds, an edited copy keeps the few runs it
has, and common phrases seed nothing. Where a document holds a seed, the item is
laid over the words around it by Smith-Waterman local alignment: +1 for an equal word,
-1/2 for a changed, missing or inserted one. The score is the best alignment divided by
the item's number of words: 1 for a copy, 0.85 with one word in ten changed.

Two passes read the documents; neither shuffles a text. The first counts the items' runs.
The second cuts out the words around seeds. Seeds, with the items they come from, are a
table that the cut-out passages are joined to, so that only runs that a filter lets
through, and passages around them, ever move. The filter is all that is broadcast: the
distinct runs of at most GRAMS places of items, as a sorted list or, beyond EXACT, as a
table of bits that lets a few others through, which the join drops. A test set of more
runs is taken in several rounds.

A text is read whole, however long. Null and empty texts hold nothing. Items of fewer than
3 words have no 3-word run and say little inside other text: they are found in the
documents whose words are just theirs, and in no longer ones. Equal documents, or equal
items, each get their rows. Of several places the first with the best score is reported.
Empty tables give an empty result; extra columns are not read.

What a seed cannot find: a copy that shares no 3-word run with its item, or only such as
are among the commoner quarter and in more than FEW documents. An item of 41 words with every third word changed still
aligns to 0.52 and is not found; with every fourth word changed (0.64) it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.llm.store import materialise
from catalens.llm.wordhash import NOT_ALNUM, gram_hashes, mix, slices, word_hashes

GRAM = 3
THRESHOLD = 0.5
COST = 0.5
RARE = 0.75
FEW = 16
#: Places of items that one round takes, and distinct runs that are held as a list.
GRAMS, EXACT = 1 << 24, 1 << 22
_BITS = 1 << 28
#: Outside ASCII: all but letters, marks, digits and controls, and two blanks of no width.
_PARTING = r"[^\x00-\x7F\p{L}\p{M}\p{N}\p{C}]|[\x{85}\x{200B}\x{FEFF}]"
_CHARACTER = r"([\p{Han}\p{Hiragana}\p{Katakana}\x{30FC}\x{FF70}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]\p{M}*)"


def parted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased texts, and where each text's words begin."""
    texts = texts.cast(pa.large_string())
    if not pc.all(pc.string_is_ascii(texts)).as_py():
        texts = pc.replace_substring_regex(texts, _PARTING, " ")
        texts = pc.replace_substring_regex(texts, _CHARACTER, r" \1 ")
    return word_hashes(texts, NOT_ALNUM)


def align(item: np.ndarray, words: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: score, first and last + 1 word of `words` it covers."""
    n = len(words)
    row, begin = np.zeros(n + 1), np.arange(n + 1)
    best, place = 0.0, (0, 0)
    steps = np.arange(n + 1) * COST
    for word in item:
        match = np.where(words == word, 1.0, -COST)
        diagonal, up = row[:-1] + match, row[1:] - COST
        new, start = np.zeros(n + 1), np.arange(n + 1)
        new[1:] = np.maximum(0.0, np.maximum(diagonal, up))
        kept = new[1:] > 0
        start[1:] = np.where(kept, np.where(diagonal >= up, begin[:-1], begin[1:]), start[1:])
        # A gap of any length to the left: the running best of score + COST * position.
        level = new + steps
        reach = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level >= reach, np.arange(n + 1), 0))
        new, start = reach - steps, start[source]
        row, begin = new, start
        at = int(row.argmax())
        if row[at] > best + 1e-9:
            best, place = float(row[at]), (int(begin[at]), at)
    return best, *place


def runs(words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and hash of all runs of GRAM words; of a shorter text one of all its words,
    marked so that it equals no longer run."""
    lengths = np.diff(firsts)
    grams = gram_hashes(words, GRAM)
    at = np.arange(len(grams))
    text = np.searchsorted(firsts, at, "right") - 1
    inside = at + GRAM <= firsts[text + 1]
    text, at, grams = text[inside], at[inside], grams[inside]
    short = np.flatnonzero((lengths > 0) & (lengths < GRAM))
    whole = [mix(gram_hashes(words[firsts[t] : firsts[t + 1]], int(lengths[t])) + np.uint64(lengths[t])) for t in short]
    return (
        np.concatenate([text, short]), np.concatenate([at - firsts[text], np.zeros(len(short), np.int64)]),
        np.concatenate([grams, *whole]).view(np.int64),
    )


class Filter:
    """Tells which runs may be among the given ones, and how far passages around them reach."""

    def __init__(self, grams: np.ndarray, reach: np.ndarray):
        order = np.argsort(grams)
        self.grams = grams[order] if len(grams) <= EXACT else None
        self.reach = reach[order] if len(grams) <= EXACT else int(reach.max())
        self.bits = np.zeros(_BITS // 8 if self.grams is None else 1 << 19, np.uint8)
        for place in self._places(grams):
            np.bitwise_or.at(self.bits, place >> 3, (1 << (place & 7)).astype(np.uint8))

    def _places(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        """One bit for each run, or three where there is no list to look it up in."""
        mask = np.uint64(len(self.bits) * 8 - 1)
        hashes = grams.view(np.uint64)
        for k in range(1 if self.grams is not None else 3):
            yield ((hashes >> np.uint64(k * 17)) & mask).astype(np.int64)

    def passing(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the runs pass, and the reach of each of these."""
        at = np.arange(len(grams))
        for place in self._places(grams):
            at = at[(self.bits[place[at] >> 3] >> (place[at] & 7)) & 1 == 1]
        if self.grams is None:
            return at, np.full(len(at), self.reach)
        found = np.minimum(np.searchsorted(self.grams, grams[at]), max(0, len(self.grams) - 1))
        hit = self.grams[found] == grams[at] if len(self.grams) else np.zeros(len(at), bool)
        return at[hit], self.reach[found[hit]]


def _merged(places: list[int], slack: int, length: int) -> list[tuple[int, int]]:
    """Windows around where the item may begin; overlapping ones become one."""
    out: list[tuple[int, int]] = []
    for p in places:
        low, high = p - slack, p + length + slack
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(high, out[-1][1])
        else:
            out.append((low, high))
    return out


def _lower(text: Column) -> Column:
    return F.lower(F.coalesce(text.cast("string"), F.lit("")))


ITEMS = T.StructType([
    T.StructField("item", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("words", T.BinaryType()),
    T.StructField("n", T.LongType()),
])
RUNS = T.StructType([
    T.StructField("gram", T.LongType()), T.StructField("item", T.LongType()), T.StructField("at", T.LongType()), T.StructField("n", T.LongType()),
])
PASSAGES = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()),
    T.StructField("begin", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("grams", T.ArrayType(T.LongType())),
    T.StructField("places", T.ArrayType(T.LongType())),
])
FOUND = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("end_word", T.LongType()),
])


def _number(at: int) -> int:
    """A number that no other row of the table has."""
    return (TaskContext.get().partitionId() << 40) + at


def _items(benchmark: DataFrame) -> DataFrame:
    """ITEMS: the test items with their words as hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                words, firsts = parted(batch.column(1).slice(start, stop - start))
                own = [words[a:b].tobytes() for a, b in zip(firsts, firsts[1:])]
                numbers = [_number(seen + k) for k in range(len(own))]
                seen += len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers), batch.column(0).slice(start, stop - start), pa.array(own, pa.binary()), pa.array(np.diff(firsts))],
                    names=ITEMS.names,
                )

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _lower(F.col("text")).alias("text"))
    return materialise(rows.mapInArrow(run, ITEMS))


def _runs_of(items: DataFrame) -> DataFrame:
    """RUNS: every run of every item with its place and the item's number of words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(w, np.uint64) for w in batch.column(1).to_pylist()]
            firsts = np.cumsum([0, *map(len, own)])
            text, at, gram = runs(np.concatenate([np.empty(0, np.uint64), *own]), firsts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram), batch.column(0).take(pa.array(text)), pa.array(at), pa.array(np.diff(firsts)[text])], names=RUNS.names
            )

    return materialise(items.select("item", "words").mapInArrow(run, RUNS))


def _filter(held: DataFrame) -> Filter | None:
    """Of the distinct runs of at most GRAMS places."""
    table = held.groupBy("gram").agg(F.max("n").alias("n")).toArrow()
    if not table.num_rows:
        return None
    # An alignment of half an item or more spans less than 1.5 times its words on either side.
    return Filter(table.column("gram").to_numpy(), table.column("n").to_numpy() * 3 // 2 + GRAM)


def _documents_with(texts: DataFrame, known: Filter) -> DataFrame:
    """gram, documents: in how many documents each run that passes stands."""
    schema = T.StructType([T.StructField("gram", T.LongType()), T.StructField("documents", T.LongType())])
    held = texts.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty(0, np.int64)]
            for start, stop in slices(batch.column(0)):
                text, _, gram = runs(*parted(batch.column(0).slice(start, stop - start)))
                at, _ = held.value.passing(gram)
                order = np.lexsort((text[at], gram[at]))
                text, gram = text[at][order], gram[at][order]
                first = np.ones(len(gram), bool)
                first[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
                found.append(gram[first])
            gram, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], names=schema.names)

    return texts.select("text").mapInArrow(count, schema).groupBy("gram").agg(F.sum("documents").alias("documents"))


def _seeds(held: DataFrame, documents_with: DataFrame) -> DataFrame:
    """The rarer part of every item's runs, by the documents and items that hold them."""
    items_with = held.select("gram", "item").distinct().groupBy("gram").agg(F.count("*").alias("items"))
    documents = F.coalesce("documents", F.lit(0))
    rarity = items_with.join(documents_with, "gram", "left").select(
        "gram", (F.col("items") + documents).alias("rarity"), (documents <= FEW).alias("few")
    )
    rated = materialise(held.join(rarity, "gram"))
    sorted_ = rated.groupBy("item").agg(F.array_sort(F.collect_list("rarity")).alias("all"))
    last = F.greatest(F.lit(0), F.ceil(F.size("all") * RARE).cast("int") - 1)
    limit = sorted_.select("item", F.get("all", last).alias("limit"))
    return materialise(rated.join(limit, "item").where("rarity <= limit OR few").select(*RUNS.names))


def _passages(texts: DataFrame, known: Filter) -> DataFrame:
    """PASSAGES: the words around seeds, with the seeds in them; overlapping ones are one."""
    held = texts.sparkSession.sparkContext.broadcast(known)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            for start, stop in slices(batch.column(2)):
                part, out = batch.slice(start, stop - start), []
                words, firsts = parted(part.column(2))
                text, at, gram = runs(words, firsts)
                passed, reach = held.value.passing(gram)
                order = np.lexsort((at[passed], text[passed]))
                text, at, gram, reach = text[passed][order], at[passed][order], gram[passed][order], reach[order]
                lengths = np.diff(firsts)
                low, high = np.maximum(0, at - reach), np.minimum(lengths[text], at + GRAM + reach)
                a = 0
                while a < len(text):
                    t, begin, end, b = int(text[a]), int(low[a]), int(high[a]), a + 1
                    while b < len(text) and text[b] == t and low[b] <= end:
                        begin, end, b = min(begin, int(low[b])), max(end, int(high[b])), b + 1
                    own = words[firsts[t] + begin : firsts[t] + end]
                    out.append((t, begin, own.tobytes(), gram[a:b], at[a:b]))
                    a = b
                rows = pa.array([x[0] for x in out], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array([_number(seen + x[0]) for x in out], pa.int64()), part.column(0).take(rows), part.column(1).take(rows),
                    pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary()),
                    pa.array([x[3] for x in out], pa.list_(pa.int64())), pa.array([x[4] for x in out], pa.list_(pa.int64())),
                ], names=PASSAGES.names)
                seen += stop - start

    return materialise(texts.select("doc_id", "text_hash", "text").mapInArrow(cut, PASSAGES))


_ALIGNED = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()),
    T.StructField("item", T.LongType()), *FOUND.fields[1:],
])


def _aligned(passages: DataFrame, seeds: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """_ALIGNED: passages and items that share seeds, where these align to the threshold."""
    numbered = materialise(passages.withColumn("passage", F.monotonically_increasing_id()))
    seen = numbered.select("passage", F.explode(F.arrays_zip("grams", "places")).alias("x"))
    seen = seen.select("passage", F.col("x.grams").alias("gram"), F.col("x.places").alias("place"))
    meets = seen.join(seeds.select("gram", "item", "at"), "gram").groupBy("passage", "item").agg(
        F.sort_array(F.collect_set(F.col("place") - F.col("at"))).alias("starts")
    )
    pairs = materialise(meets).join(numbered.drop("grams", "places"), "passage").join(
        items.select("item", "item_id", F.col("words").alias("item_words")), "item"
    )

    def align_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = []
                for r in batch.slice(at, 512).to_pylist():
                    item, own = np.frombuffer(r["item_words"], np.uint64), np.frombuffer(r["words"], np.uint64)
                    slack, best = len(item) // 2 + 2, (0.0, 0, 0)
                    for low, high in _merged([p - r["begin"] for p in r["starts"]], slack, len(item)):
                        low, high = max(0, low), min(len(own), high)
                        score, a, b = align(item, own[low:high])
                        if score > best[0] + 1e-9:
                            best = score, low + a + r["begin"], low + b + r["begin"]
                    if best[0] / len(item) >= threshold:
                        out.append({
                            **{c: r[c] for c in ("row", "doc_id", "text_hash", "item", "item_id")},
                            "score": best[0] / len(item), "first_word": best[1], "end_word": best[2],
                        })
                yield pa.RecordBatch.from_pylist(out, _ALIGNED_ARROW)

    columns = ["row", "doc_id", "text_hash", "begin", "words", "starts", "item", "item_id", "item_words"]
    found = pairs.select(*columns).mapInArrow(align_all, _ALIGNED)
    # A text may hold an item in several passages.
    best = F.max(F.struct("score", (-F.col("first_word")).alias("early"), "end_word"))
    best = found.groupBy("row", "doc_id", "text_hash", "item", "item_id").agg(best.alias("best"))
    return best.select(
        "row", "doc_id", "text_hash", "item", "item_id", "best.score", (-F.col("best.early")).alias("first_word"), "best.end_word"
    )


_ALIGNED_ARROW = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("item", pa.int64()), ("item_id", pa.int64()),
    ("score", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64()),
])


def _found(documents: DataFrame, benchmark: DataFrame, threshold: float, grams: int) -> DataFrame:
    """_ALIGNED rows of all documents and items."""
    spark = documents.sparkSession
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"),
        _lower(F.col("text")).alias("text"),
    )
    items = _items(benchmark)
    places = _runs_of(items)
    rounds = max(1, -(-places.count() // grams))
    out = spark.createDataFrame([], _ALIGNED)
    for number in range(rounds):
        # All runs of an item are in one round.
        held = places.where(F.pmod(F.xxhash64("item"), F.lit(rounds)) == number)
        known = _filter(held)
        if known is None:
            continue
        seeds = _seeds(held, _documents_with(texts, known))
        out = out.unionByName(_aligned(_passages(texts, _filter(seeds)), seeds, items, threshold))
    return materialise(out)


def leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, grams: int = GRAMS) -> DataFrame:
    """A row per document and item it holds: score, and the words (counted from 0) that match."""
    return _found(documents, benchmark, threshold, grams).select(*FOUND.names)


def without_leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, grams: int = GRAMS) -> DataFrame:
    """The rows of `documents` that hold no test item, with all their columns."""
    columns = documents.columns
    bad = _found(documents, benchmark, threshold, grams).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = documents.withColumn("__text", F.xxhash64(text))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash"))
    return keyed.join(bad, same, "left_anti").select(*[F.col(f"`{c}`") for c in columns])
