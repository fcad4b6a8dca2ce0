"""License scans: exact set-similarity join of text blocks with license templates.

Words are runs of ASCII letters and digits and of everything beyond ASCII,
after lower-casing A-Z. A block of a template is a window of ``2 * L`` words that
begins at a multiple of ``L`` (L: words of this template; the last may be
shorter), so every passage of up to L words lies in one. A block matches if
it contains at least ``threshold`` of the template's distinct words and, in order and
in one piece, the words that tell this licence from its neighbours (``mark``).

The join is exact. Template words are ordered by their frequency in all
documents, rarest first. A template that needs k of its n words can only match
a block that holds one of its n - k + 1 first words (prefix), that has at least
k template words (length), and whose words left from there on still suffice
(position). Blocks that pass are counted in full.

Phrases (the base), notices (short licence names, labels of the method) and marks
need every word in order: each place where the rarest word of
one stands is a candidate, confirmed by the words around it.

Templates are a given, small set: their words must number at most
``max_words`` (checked), which bounds what every task holds.

Defined results: a null text is empty; no words give n_words 0, no labels,
score 0; rows with a null or repeated id are scanned each for itself.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sums
from .common import hash_of, text_chunks, word_hashes

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Short names of licences in order, and their labels.
NOTICES = {
    "all rights reserved": "all-rights-reserved",
    "apache license 2": "apache-2",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "under the bsd license": "bsd",
    "boost software license": "bsl-1",
    "cc by 3": "cc-by",
    "cc by 4": "cc-by",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0 1": "cc0",
    "gnu affero general public license": "agpl",
    "gnu general public license version 2": "gpl",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "mozilla public license 2": "mpl-2",
    "mozilla public license v 2": "mpl-2",
    "mozilla public license version 2": "mpl-2",
}

# Labels, marks and opening words of public licence notices.
TEMPLATES = [
    ("mit", "deal in the software without restriction",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the Software), to deal in the Software without restriction"),
    ("apache-2", "apache license version 2",
     "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
     "compliance with the License"),
    ("gpl-3", "gnu general public license version 3",
     "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "gnu general public license",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation"),
    ("lgpl", "lesser general public license",
     "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
     "Public License as published by the Free Software Foundation"),
    ("agpl", "affero general public license",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
     "Public License as published by the Free Software Foundation"),
    ("bsd", "source and binary forms with or without modification",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met"),
    ("isc", "use copy modify and or distribute this software",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsl-1", "any person or organization obtaining a copy",
     "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
     "accompanying documentation covered by this license"),
    ("unlicense", "unencumbered software released into the public domain",
     "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "attribution noncommercial 4",
     "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-sa", "attribution sharealike 4",
     "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nd", "attribution noderivatives 4",
     "This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License"),
    ("cc-by", "commons attribution 4",
     "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl-2", "mozilla public license v 2",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]

SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
          "labels array<string>, score double")
_ROWS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                   ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())),
                   ("score", pa.float64())])
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split_words(text: str) -> list[str]:
    return _WORDS.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def _texts(templates: list[tuple[str, str, str]], *phrases: dict[str, str]) -> list[str]:
    return [x for _, mark, text in templates for x in (mark, text)] + [p for group in phrases for p in group]


class Index:
    """Template words as numbers, rarest first; prefixes; phrases."""

    def __init__(self, templates: list[tuple[str, str, str]], phrases: dict[str, str], notices: dict[str, str],
                 frequency: dict[str, int], threshold: float):
        vocabulary = sorted({w for t in _texts(templates, phrases, notices) for w in split_words(t)}, key=lambda w: (frequency.get(w, 0), w))
        number = {w: i for i, w in enumerate(vocabulary)}
        hashes = np.array([hash_of(w) for w in vocabulary], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order

        def ordered(text: str) -> np.ndarray:
            return np.array([number[w] for w in split_words(text)], np.int64)

        self.labels, self.sets, self.needs, self.marks, self.spans = [], [], [], [], []
        for label, mark, text in templates:
            words = np.unique(ordered(text))
            if len(words):
                self.labels.append(label)
                self.sets.append(words)
                self.needs.append(max(1, int(np.ceil(threshold * len(words) - 1e-9))))
                self.marks.append(ordered(mark))
                self.spans.append(len(split_words(text)))
        #: of each word, the templates with it in their prefix, and its position there
        self.by_prefix: list[list[tuple[int, int]]] = [[] for _ in range(len(vocabulary) + 1)]
        for t, (words, need) in enumerate(zip(self.sets, self.needs, strict=True)):
            for position, word in enumerate(words[:len(words) - need + 1]):
                self.by_prefix[int(word)].append((t, position))
        self.in_prefix = np.array([bool(x) for x in self.by_prefix])
        self.phrases = [(label, ordered(p), base) for group, base in ((phrases, True), (notices, False))
                        for p, label in group.items() if split_words(p)]

    def number(self, h: np.ndarray) -> np.ndarray:
        """Number of each word, -1 where it is in no template."""
        if not len(self.hashes) or not len(h):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.numbers[at], -1)

    @staticmethod
    def places(numbers: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Where ``words`` stand in order, found by the rarest of them."""
        pivot = int(words.argmin())
        start = np.flatnonzero(numbers == words[pivot]) - pivot
        start = start[(start >= 0) & (start + len(words) <= len(numbers))]
        for k, word in enumerate(words):
            start = start[numbers[start + k] == word]
        return start

    def containment(self, t: int, word: int, position: int, block: np.ndarray) -> float:
        """Share of template ``t`` in a block that holds its word at ``position``; 0 if it does not match."""
        words, need = self.sets[t], self.needs[t]
        mine = np.unique(block[block >= 0])
        j = int(np.searchsorted(mine, word))
        before = len(np.intersect1d(words[:position], mine[:j], assume_unique=True))
        if len(mine) < need or before + min(len(words) - position, len(mine) - j) < need:
            return 0.0
        common = before + len(np.intersect1d(words[position:], mine[j:], assume_unique=True))
        mark = self.marks[t]
        return common / len(words) if common >= need and (not len(mark) or len(self.places(block, mark))) else 0.0

    def scan(self, numbers: np.ndarray):
        """places and labels of phrases, labels and best containment of templates, in one document's words."""
        places, base, labels = [], set(), set()
        for label, words, is_base in self.phrases:
            start = self.places(numbers, words)
            if len(start):
                labels.add(label)
                if is_base:
                    places += start.tolist()
                    base.add(label)
        score = 1.0 if labels else 0.0
        hits = np.flatnonzero(self.in_prefix[numbers])
        seen = set()
        for at, word in zip(hits.tolist(), numbers[hits].tolist(), strict=True):
            for t, position in self.by_prefix[word]:
                span = self.spans[t]
                for b in (at // span - 1, at // span):
                    if b >= 0 and (t, b, word) not in seen:
                        seen.add((t, b, word))
                        share = self.containment(t, word, position, numbers[b * span:(b + 2) * span])
                        if share:
                            labels.add(self.labels[t])
                            score = max(score, share)
        return places, base, labels, score


def _scan_batches(index: Index):
    def run(batches):
        for batch, offsets, data in text_chunks(batches):
            h, first = word_hashes(data, offsets)
            number = index.number(h)
            some = np.unique(np.searchsorted(first, np.flatnonzero(number >= 0), "right") - 1)
            found = {int(i): index.scan(number[first[i]:first[i + 1]]) for i in some}
            empty = ([], set(), set(), 0.0)
            rows = [found.get(i, empty) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array([len(r[0]) for r in rows], pa.int64()),
                 pa.array([min(r[0], default=None) for r in rows], pa.int64()), pa.array([max(r[0], default=None) for r in rows], pa.int64()),
                 pa.array([sorted(r[1]) for r in rows], pa.list_(pa.string())), pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string())),
                 pa.array([r[3] for r in rows], pa.float64())], schema=_ROWS)

    return run


def _frequency_batches(hashes: np.ndarray):
    def run(batches):
        total = np.zeros(len(hashes), np.int64)
        for _, offsets, data in text_chunks(batches):
            h, _ = word_hashes(data, offsets)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            total += np.bincount(at[hashes[at] == h], minlength=len(hashes))
        yield sums.rows({"frequency": total}, TaskContext.get().partitionId())

    return run


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each given word stands in all documents."""
    if not vocabulary:
        return {}
    hashes = np.array([hash_of(w) for w in vocabulary], np.uint64)
    order = np.argsort(hashes)
    total = sums.collected(docs.select("text").mapInArrow(_frequency_batches(hashes[order]), sums.SCHEMA)).get("frequency")
    if total is None:
        return {}
    return {vocabulary[i]: int(n) for i, n in zip(order, total, strict=True)}


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES,
                  notices: dict[str, str] = NOTICES, threshold: float = 0.8, max_words: int = 100_000) -> DataFrame:
    """A row per document: word count, places of the phrases, labels and the best containment."""
    vocabulary = sorted({w for t in _texts(templates, phrases, notices) for w in split_words(t)})
    if len(vocabulary) > max_words:
        raise ValueError(f"templates have {len(vocabulary)} words; at most {max_words} can be held by every task")
    index = Index(templates, phrases, notices, frequencies(docs, vocabulary), threshold)
    return docs.select("doc_id", "text").mapInArrow(_scan_batches(index), SCHEMA)


def digest(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"base_labels": F.array_join("base_labels", ","), "labels": F.array_join("labels", ",")})
