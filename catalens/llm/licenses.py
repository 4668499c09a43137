"""License statements found through a positional index of their rare words.

A template is a license notice as a list of words, with key phrases that a copy must
hold. The index has a posting (word, place in the template) for every word. How rare
a word is, is counted over all documents (the number of those that hold it). In each
file the places of the licence words are looked up; for a template only the highest
IDF words among those that are mandatory anyway, so nothing is lost by leaving the
others out. Places of these words that stand in the same relative position as in the
template, give or take the slack, are candidates. They are verified: the first key
phrase stands there word by word, every other key phrase within the slack of its
place, and at least `cover` of the template's words are in place.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased; they
are compared as 64-bit hashes with their length. A null or empty text has no words and
no licence. Repeated rows are scanned each; ids may be null. An empty table gives no
rows, and a corpus without any licence word ranks all words alike. Places that tie in
everything are all found. Only the id and text columns are read. Texts are scanned
whole; a text longer than a batch slice is one slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.llm.wordhash import NOT_ALNUM, slices, text_bytes, words_of

#: Words by which a part of a long notice may be out of place; single phrases allow none.
SLACK = 6
#: Share of a notice's words that must be in place.
COVER = 0.6
#: How many of a template's mandatory words are looked up and intersected.
RARE = 3


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...] = ()  # none: the whole text
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def keys(self) -> list[tuple[int, list[str]]]:
        """Place in the template and words of each key phrase."""
        words, keys = self.words, []
        for phrase in self.phrases or (self.text,):
            own = phrase.split()
            keys.append((next(i for i in range(len(words)) if words[i : i + len(own)] == own), own))
        return keys

    @property
    def slack(self) -> int:
        return SLACK if self.phrases else 0


# The phrases whose places are counted, and their labels.
BASE = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
)

# Names and notices of public licences, lower-case, without punctuation.
NOTICES = (
    Template("agpl", "gnu affero general public license"),
    Template("apache-2.0", "apache license version 2 0"),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        ("apache license version 2 0", "except in compliance with the license"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met",
        ("redistribution and use in source and binary forms", "the following conditions are met"),
    ),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc0", "cc0 1 0 universal"),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template(
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation",
        ("free software you can redistribute it", "as published by the free software foundation"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
        "that the above copyright notice and this permission notice appear in all copies",
        ("for any purpose with or without fee", "this permission notice appear in all copies"),
    ),
    Template("lgpl", "gnu lesser general public license"),
    Template("mit", "mit license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
        "files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template("mpl-2.0", "mozilla public license v 2 0"),
    Template(
        "unlicense", "this is free and unencumbered software released into the public domain",
        ("free and unencumbered software", "public domain"),
    ),
)
TEMPLATES = BASE + NOTICES

SCANNED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_words", T.LongType()),
    T.StructField("found", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType()), T.StructField("n", T.LongType()),
        T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("score", T.DoubleType()),
    ]))),
])
_FOUND_ARROW = pa.struct([
    ("label", pa.string()), ("base", pa.bool_()), ("n", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()),
])
_COUNTED = T.StructType([T.StructField("word", T.IntegerType()), T.StructField("n", T.LongType())])


class Vocabulary:
    """Numbers for the words of the templates, found again by hash and length."""

    def __init__(self, templates: tuple[Template, ...]):
        self.words = sorted({w for t in templates for w in t.words})
        joined = pa.array(self.words)
        hashes, lengths, _ = words_of(*text_bytes(joined), NOT_ALNUM)
        assert len(hashes) == len(self.words)  # every word is one word
        self.order = np.argsort(hashes)
        self.hashes, self.lengths = hashes[self.order], lengths[self.order]
        self.number = {w: i for i, w in enumerate(self.words)}

    def numbers(self, hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of each word of a text, -1 for others."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = (self.hashes[at] == hashes) & (self.lengths[at] == lengths)
        return np.where(known, self.order[at], -1)


def _source(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return documents.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"))


def _slices(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Per slice of a batch: ids, word numbers of all texts, and where each text's words begin."""
    for batch in batches:
        for start, stop in slices(batch.column(1)):
            part = batch.slice(start, stop - start)
            hashes, lengths, firsts = words_of(*text_bytes(part.column(1)), NOT_ALNUM)
            yield part.column(0), vocabulary.numbers(hashes, lengths), firsts


def document_frequencies(
    documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_column: str = "doc_id", text_column: str = "text"
) -> dict[str, int]:
    """In how many documents each licence word stands, over all documents; a row per licence
    word reaches the driver."""
    vocabulary = Vocabulary(templates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(vocabulary.words), np.int64)
        for _, numbers, firsts in _slices(batches, vocabulary):
            places = np.flatnonzero(numbers >= 0)
            text = np.searchsorted(firsts, places, "right") - 1
            pairs = np.unique(text * len(held) + numbers[places])
            held += np.bincount(pairs % len(held), minlength=len(held))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held)), pa.int32()), pa.array(held)], names=_COUNTED.names)

    counted = _source(documents, id_column, text_column).mapInArrow(count, _COUNTED)
    found = dict(counted.groupBy("word").agg(F.sum("n")).collect())
    return {w: found.get(i, 0) for i, w in enumerate(vocabulary.words)}


def _any_between(places: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether one of the ascending `places` lies in low..high (both included)."""
    if not len(places):
        return np.zeros(len(low), bool)
    at = np.searchsorted(places, low)
    return (at < len(places)) & (places[np.minimum(at, len(places) - 1)] <= high)


class Index:
    """Templates with their mandatory words in descending IDF."""

    def __init__(self, templates: tuple[Template, ...], frequencies: dict[str, int]):
        self.templates, self.vocabulary = templates, Vocabulary(templates)
        number = self.vocabulary.number
        self.size = len(self.vocabulary.words)
        self.plans = []
        for template in templates:
            postings = {w: start + i for start, key in reversed(template.keys) for i, w in reversed(list(enumerate(key)))}
            # The highest IDF is the lowest frequency.
            rare = sorted(postings, key=lambda w: (frequencies.get(w, 0), w))[:RARE]
            keys = []
            for start, key in template.keys:
                rarest = min(range(len(key)), key=lambda i: (frequencies.get(key[i], 0), i))
                keys.append((start, rarest, np.array([number[w] for w in key])))
            self.plans.append((
                [(number[w], postings[w]) for w in rare], keys, np.array([number[w] for w in template.words]), template.slack,
            ))

    def hits(self, numbers: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Template, texts, places in the text and scores of its verified copies."""
        known = np.flatnonzero(numbers >= 0)
        order = np.argsort(numbers[known], kind="stable")
        bounds = np.searchsorted(numbers[known][order], np.arange(self.size + 1))
        known = known[order]

        def places(word: int) -> np.ndarray:
            return known[bounds[word] : bounds[word + 1]]

        def text_of(at: np.ndarray) -> np.ndarray:
            return np.searchsorted(firsts, at, "right") - 1

        def standing(rarest: int, key: np.ndarray) -> np.ndarray:
            """Where the words of a key phrase stand one after the other in one text."""
            starts = places(key[rarest]) - rarest
            starts = starts[(starts >= 0) & (starts + len(key) <= len(numbers))]
            for i, word in enumerate(key):
                starts = starts[numbers[starts + i] == word]
            return starts[text_of(starts) == text_of(starts + len(key) - 1)]

        for which, (rare, keys, words, slack) in enumerate(self.plans):
            candidates = places(rare[0][0]) - rare[0][1]
            for word, at in rare[1:]:
                candidates = candidates[_any_between(places(word) - at, candidates - 2 * slack, candidates + 2 * slack)]
            if not len(candidates):
                continue
            start, rarest, key = keys[0]
            at = standing(rarest, key)
            at = at[_any_between(candidates, at - start - slack, at - start + slack)]
            text = text_of(at)
            origin, low, high = at - start, firsts[text], firsts[text + 1]
            for start, rarest, key in keys[1:]:
                there = standing(rarest, key)
                good = _any_between(
                    there, np.maximum(origin + start - slack, low), np.minimum(origin + start + slack, high - len(key))
                )
                at, text, origin, low, high = at[good], text[good], origin[good], low[good], high[good]
            held = np.zeros(len(at), np.int64)
            for i, word in enumerate(words):
                held += _any_between(places(word), np.maximum(origin + i - slack, low), np.minimum(origin + i + slack, high - 1))
            score = held / len(words)
            good = score >= COVER
            if good.any():
                yield which, text[good], (at - low)[good], score[good]


def scan(
    documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, n_words, found per row of `documents`.

    `found` has an entry per template with a copy in the text: its label, whether it is
    a base phrase, the number of copies, the first and last word where one starts (from
    0) and the best share of words in place.
    """
    index = Index(templates, document_frequencies(documents, templates, id_column, text_column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, numbers, firsts in _slices(batches, index.vocabulary):
            entries: list[tuple[int, int, dict]] = []
            for which, text, place, score in index.hits(numbers, firsts):
                # Copies come in ascending order of text and place.
                cuts = np.flatnonzero(np.diff(text, prepend=-1))
                for a, b in zip(cuts, [*cuts[1:], len(text)]):
                    entries.append((int(text[a]), which, {
                        "label": index.templates[which].label, "base": index.templates[which].base, "n": int(b - a),
                        "first": int(place[a]), "last": int(place[b - 1]), "score": float(score[a:b].max()),
                    }))
            entries.sort(key=lambda e: e[:2])
            offsets = np.searchsorted([e[0] for e in entries], np.arange(len(ids) + 1))
            found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([e[2] for e in entries], _FOUND_ARROW))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(firsts)), found], names=SCANNED.names)

    return _source(documents, id_column, text_column).mapInArrow(run, SCANNED)


def label_documents(documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per row: n_words, places of the base phrases, their labels, all labels, best score."""
    base = F.filter("found", lambda f: f["base"])

    def joined(found):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda f: f["label"]))), ",")

    return scan(documents, templates).select(
        "doc_id",
        "n_words",
        F.aggregate(base, F.lit(0).cast("long"), lambda total, f: total + f["n"]).alias("n_base"),
        F.array_min(F.transform(base, lambda f: f["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda f: f["last"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["score"])), F.lit(0.0)).alias("score"),
    )
