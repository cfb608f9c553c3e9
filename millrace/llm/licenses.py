"""Licence notices by a positional index of rare words.

1. The words of all templates are counted over all documents (in how many each stands): a table as long as the templates' vocabulary.
2. The index has, for each template, postings (word, template, position) of its rarest places only. A template of n words of which m must
   fit needs n - m + 1 places: a text that fits m of n has at least one of any such set. A phrase that must fit wholly needs its rarest word.
3. A text's words that stand in the index, its rarest licence words, give candidates: template and start, the word's place less the
   place in the template. Candidates are settled by intersecting all of the template's postings at relative positions: the places of
   the template that hold its word there, or up to `slack` words off where words were put in or left out.
4. What fits well enough must also hold the template's key phrases verbatim, within its stretch.

A template with need 1 and slack 0 is a phrase: all its places count. Of the others only the best start of each is kept. Words are maximal runs of
letters, digits and characters beyond ASCII, A-Z lower-cased. Null and empty texts have no words, empty labels and score 0. Every row gives
a row; null and repeated ids are returned as they are; empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from math import ceil, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices_of_bytes, texts_of, word_lists, word_table

LETTERS = word_table(b"0123456789abcdefghijklmnopqrstuvwxyz")


class Template(NamedTuple):
    """Words of a notice, the share of them that must fit, how many words off, and phrases that must stand in it."""

    label: str
    text: str
    need: float = 1.0
    slack: int = 0
    keys: tuple[str, ...] = ()


# The phrases that every scan counts, with their labels.
PHRASES = (
    Template("mit", "mit license"),
    Template("apache", "apache license"),
    Template("gpl", "general public license"),
)

# Opening sentences of well-known public notices, and the short forms by which texts name them.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", 0.8, 2, ("permission is hereby granted",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.8, 2, ("with or without fee",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.8, 2, ("source and binary forms",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", 0.75, 1, ("apache license", "version 2 0")),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", 0.75, 1, ("general public license", "version 2")),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", 0.75, 1, ("general public license", "version 3")),
    Template("lgpl", "licensed under the gnu lesser general public license", 0.75, 1, ("lesser general public license",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", 0.75, 2, ("mozilla public license",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", 0.8, 1, ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", 0.8, 1, ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", 0.8, 1, ("cc by nc 4 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", 0.8, 2, ("public domain",)),
    Template("all-rights-reserved", "all rights reserved", 1.0, 0, ()),
)


def words_of(text: str) -> list[bytes]:
    return [w for some in word_lists(text.encode(), LETTERS) for w in some]


class Vocabulary:
    """The words of all templates by number, and texts as arrays of these numbers, -1 for other words."""

    def __init__(self, templates: tuple[Template, ...]):
        self.words = sorted({w for t in templates for part in (t.text, *t.keys) for w in words_of(part)})
        self.numbers = {w: i for i, w in enumerate(self.words)}

    def encode(self, text: bytes) -> np.ndarray:
        parts = [np.fromiter(map(self.numbers.get, some, repeat(-1)), np.int16 if len(self.words) < 1 << 15 else np.int32, len(some)) for some in word_lists(text, LETTERS)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int16)


def word_frequencies(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> tuple[int, dict[int, int]]:
    """The number of documents, and of those that hold each word of the vocabulary."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(len(vocabulary.words), np.int64), 0
        for batch in slices_of_bytes(batches):
            for one in texts_of(batch):
                found = np.unique(vocabulary.encode(one))
                counts[found[found >= 0]] += 1
                n += 1
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int64()), pa.array([n, *counts[some].tolist()], pa.int64())], ["word", "n"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(rows, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {r.word: r.n for r in found.collect()}
    return counts.pop(-1, 0), counts


class RareIndex:
    """Postings (template, position) of the words at each template's rarest places."""

    def __init__(self, templates: tuple[Template, ...], vocabulary: Vocabulary, documents: int, frequencies: dict[int, int]):
        self.templates, self.vocabulary = templates, vocabulary
        idf = np.array([log((documents + 1) / (frequencies.get(i, 0) + 1)) for i in range(len(vocabulary.words))])
        numbers = vocabulary.numbers
        self.patterns = [np.array([numbers[w] for w in words_of(t.text)], np.int64) for t in templates]
        self.keys = [[np.array([numbers[w] for w in words_of(k)], np.int64) for k in t.keys] for t in templates]
        self.needs = [ceil(t.need * len(p) - 1e-9) for t, p in zip(templates, self.patterns, strict=True)]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for number, (pattern, need) in enumerate(zip(self.patterns, self.needs, strict=True)):
            rarest = np.argsort(-idf[pattern], kind="stable")[: len(pattern) - need + 1]
            for place in rarest.tolist():
                self.postings.setdefault(int(pattern[place]), []).append((number, place))
        self.rare = np.zeros(len(vocabulary.words) + 1, bool)  # the last one for -1
        self.rare[list(self.postings)] = True

    def _candidates(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """For each template the starts that a rare word points to."""
        starts: dict[int, list[np.ndarray]] = {}
        places = np.flatnonzero(self.rare[words])
        held = words[places]
        for word in np.unique(held).tolist():
            for number, place in self.postings[word]:
                slack = self.templates[number].slack
                starts.setdefault(number, []).append((places[held == word] - place)[:, None] + np.arange(-slack, slack + 1))
        return {n: np.unique(np.concatenate([s.ravel() for s in found])) for n, found in starts.items()}

    def _stand(self, words: np.ndarray, pattern: np.ndarray, starts: np.ndarray, slack: int) -> np.ndarray:
        """How many places of the pattern hold their word, for each start."""
        found = np.zeros((len(starts), len(pattern)), bool)
        for off in range(-slack, slack + 1):
            at = starts[:, None] + (np.arange(len(pattern)) + off)
            found |= words.take(at, mode="clip") == pattern if off == 0 and len(at) and at[0, 0] >= 0 and at[-1, -1] < len(words) else (words.take(at, mode="clip") == pattern) & (at >= 0) & (at < len(words))
        return found.sum(axis=1)

    def _keyed(self, words: np.ndarray, number: int, start: int) -> bool:
        slack = self.templates[number].slack
        stretch = words[max(0, start - slack) : start + len(self.patterns[number]) + slack]
        return all(len(stretch) >= len(k) and (np.lib.stride_tricks.sliding_window_view(stretch, len(k)) == k).all(axis=1).any() for k in self.keys[number])

    def matches(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, start, words that fit), by template and start."""
        out = []
        for number, starts in sorted(self._candidates(words).items()):
            template, pattern = self.templates[number], self.patterns[number]
            fits = self._stand(words, pattern, starts, template.slack)
            good = np.flatnonzero(fits >= self.needs[number])
            if template.need == 1 and not template.slack:
                out += [(number, int(starts[i]), len(pattern)) for i in good if self._keyed(words, number, int(starts[i]))]
            else:
                for i in good[np.lexsort((starts[good], -fits[good]))].tolist():
                    if self._keyed(words, number, int(starts[i])):
                        out.append((number, int(starts[i]), int(fits[i])))
                        break
        return out


def _scan_rows(index: RareIndex):
    names = [t.label for t in index.templates]
    kind = pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("start", pa.int64()), ("n_fit", pa.int64()), ("share", pa.float64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of_bytes(batches):
            words, found = [], []
            for one in texts_of(batch):
                encoded = index.vocabulary.encode(one)
                words.append(len(encoded))
                found.append([{"template": n, "label": names[n], "start": s, "n_fit": k, "share": k / len(index.patterns[n])} for n, s, k in index.matches(encoded)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(found, kind)], ["doc_id", "n_words", "matches"])

    return rows


def find_notices(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, matches) of every row of docs. matches: structs of template (its number), label, start in words, n_fit and share, the words that fit."""
    vocabulary = Vocabulary(templates)
    index = RareIndex(templates, vocabulary, *word_frequencies(docs, vocabulary, text))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_scan_rows(index), f"doc_id {kind}, n_words long, matches array<struct<template int, label string, start long, n_fit long, share double>>")


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of docs: the places of the phrases, their labels,
    those of whole notices too, and the best share of words that fit."""
    found = find_notices(docs, PHRASES + NOTICES, doc_id, text)
    base = F.filter("matches", lambda m: m["template"] < len(PHRASES))

    def labels(matches):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    starts = F.transform(base, lambda m: m["start"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )
