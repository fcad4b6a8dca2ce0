"""Quality rules: repetition inside a text, by a suffix array over its words.

Words are parted by white space (bytes 9 to 13 and 32) and compared as they
stand. All suffixes of a text's words are sorted by prefix doubling, which goes
on with the suffixes that are still tied only. Common prefixes of neighbours
are counted for the irreducible positions (their sum grows as n log n) and
carried on to the others. A longest-common-prefix interval of value p is a
substring of p words that stands at every suffix of the interval; a suffix's
deepest interval has the greater of its two neighbour values. The union of these
spans from ``min_words`` words on is what repeats in the text (of a substring
that is not maximal, the span lies within the one of the substring that is).

A text is kept if it has at least ``fewest_words`` words, the words in repeats of
``window`` words or more are at most ``most_repeated`` percent of all words, the
characters in repeats of ``min_words`` words or more are at most ``most_covered`` percent of all
characters of words, and no repeat is longer than ``longest`` words and also than ``longest_share``
percent of the words.

Texts of a chunk are sorted at once: a word counts as another one in another
text, so no substring reaches over a text's end. One longer text is a chunk of
its own; memory grows with the chunk only. No shuffle.

Defined results: a null text has no words and is not kept; rows stand for
themselves, also with null or repeated ids; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE_BYTES, mix, prefix_hash, rows_of, ship, span_hash, text_chunks, words

#: Characters that count as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: First bytes of characters in UTF-8 (any byte that continues none).
LEADS = (np.arange(256) & 0xC0) != 0x80


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``tokens`` (any sortable values; an end comes before every token)."""
    n = len(tokens)
    suffixes = np.argsort(tokens, kind="stable")
    rank = np.empty(n, np.int64)

    def settle(place: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Rank the suffixes at ``place`` by the place of their group's head; the places that are still tied."""
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(place)))
        rank[suffixes[place]] = np.repeat(place[head], size)
        return place[np.repeat(size > 1, size)]

    if not n:
        return suffixes
    ordered = tokens[suffixes]
    tied = settle(np.arange(n), np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    done = 1
    while len(tied):
        s = suffixes[tied]
        after = s + done
        key = rank[s] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        suffixes[tied], key = s[order], key[order]
        tied = settle(tied, np.concatenate([[True], key[1:] != key[:-1]]))
        done *= 2
    return suffixes


def _common(tokens: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, each pair by itself."""
    n = len(tokens)
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(np.maximum(a, b) < n)
    while len(live) > 64:
        at = out[live]
        same = tokens[a[live] + at] == tokens[b[live] + at]
        live = live[same]
        out[live] += 1
        live = live[np.maximum(a[live], b[live]) + out[live] < n]
    for k in live.tolist():  # few long ones: in growing blocks
        i, j, done, block = int(a[k]), int(b[k]), int(out[k]), 64
        while True:
            x, y = tokens[i + done:i + done + block], tokens[j + done:j + done + block]
            m = min(len(x), len(y))
            other = np.flatnonzero(x[:m] != y[:m])
            if len(other) or m < block:
                out[k] = done + (int(other[0]) if len(other) else m)
                break
            done, block = done + block, min(block * 2, 1 << 20)
    return out


def neighbour_prefixes(tokens: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """For every position: the longer common prefix of its suffix with a neighbour in the suffix array."""
    n = len(tokens)
    if n < 2:
        return np.zeros(n, np.int64)
    before = np.full(n, -1, np.int64)  # the suffix sorted just before
    before[suffixes[1:]] = suffixes[:-1]
    position = np.arange(n)
    # where the words before both suffixes are the same, the prefix is the last position's less one
    carried = np.zeros(n, bool)
    carried[1:] = (before[1:] > 0) & (before[:-1] >= 0)
    carried[carried] = tokens[position[carried] - 1] == tokens[before[carried] - 1]
    own = np.flatnonzero(~carried)
    shared = np.zeros(n, np.int64)
    some = own[before[own] >= 0]
    shared[some] = _common(tokens, some, before[some])
    source = np.maximum.accumulate(np.where(carried, 0, position))
    shared = shared[source] - (position - source)
    out = shared.copy()
    np.maximum.at(out, before[suffixes[1:]], shared[suffixes[1:]])
    return out


def _covered(length: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in a span [i, i + length[i]) of at least ``least``."""
    n = len(length)
    reach = np.maximum.accumulate(np.where(length >= least, np.arange(n) + length, 0))
    return np.arange(n) < reach


def _tokens(data: np.ndarray, offsets: np.ndarray):
    """(word by text, text number) of every word, the words' bounds in ``first`` as in :func:`words`, and their bytes."""
    start, end, first = words(data, offsets, NON_SPACE_BYTES)
    row = rows_of(np.diff(first))
    return mix(span_hash(prefix_hash(data), start, end) ^ mix(row.astype(np.uint64) + np.uint64(1))), row, first, start, end


def repetition(data: np.ndarray, offsets: np.ndarray, min_words: int, window: int) -> dict[str, np.ndarray]:
    """Counts per text: words, characters of words, and what repeats."""
    n = len(offsets) - 1
    token, row, first, start, end = _tokens(data, offsets)
    length = neighbour_prefixes(token, suffix_array(token))
    leads = np.concatenate([[0], np.cumsum(LEADS[data])])
    chars = leads[end] - leads[start]

    def total(values):
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[first[1:]] - sums[first[:-1]]

    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, row, length)
    return {"n_words": np.diff(first), "word_chars": total(chars), "n_repeat_words": total(_covered(length, window)),
            "covered_chars": total(chars * _covered(length, min_words)), "longest_repeat": longest}


def duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines per text that hold a word and equal an earlier line (line ends: byte 10)."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(n, np.int64)
    inside = np.ones(256, bool)
    inside[10] = False
    start, end, first = words(data, offsets, inside)
    row = rows_of(np.diff(first))
    ink = np.concatenate([[0], np.cumsum(NON_SPACE_BYTES[data])])
    some = ink[end] > ink[start]
    h, row = span_hash(prefix_hash(data), start, end)[some], row[some]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row[again], minlength=n)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_chars", "longest_repeat")


def _batches(min_words: int, window: int):
    def run(batches):
        for batch, offsets, data in text_chunks(batches):
            symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
            counts = repetition(data, offsets, min_words, window) | {
                "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]], "n_dup_lines": duplicate_lines(data, offsets)}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(counts[c], pa.int64()) for c in _COUNTS)], names=["doc_id", *_COUNTS])

    return run


def repeated_spans(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """doc_id, first_word, n_words: the united spans of repeated substrings of ``min_words`` words or more (words count from 0)."""
    ship(docs.sparkSession)

    def run(batches):
        for batch, offsets, data in text_chunks(batches):
            token, row, first = _tokens(data, offsets)[:3]
            inside = np.concatenate([[False], _covered(neighbour_prefixes(token, suffix_array(token)), min_words), [False]])
            cut = np.concatenate([[False], row[1:] != row[:-1], [False]]) if len(row) else np.zeros(1, bool)
            begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
            end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row[begin])), pa.array(begin - first[row[begin]]), pa.array(end - begin)],
                                             names=["doc_id", "first_word", "n_words"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, first_word long, n_words long")


def repetition_rules(docs: DataFrame, min_words: int = 5, window: int = 8, fewest_words: int = 20, most_repeated: int = 30,
                     most_covered: int = 30, longest: int = 100, longest_share: int = 20) -> DataFrame:
    """doc_id, the counts, ``base_failed`` and ``kept`` for every row."""
    ship(docs.sparkSession)
    counted = docs.select("doc_id", "text").mapInArrow(
        _batches(min_words, window), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in _COUNTS))
    n = F.col("n_words")
    failed = (n < fewest_words) | (F.col("n_repeat_words") * 100 > n * most_repeated)
    too_long = (F.col("longest_repeat") > longest) & (F.col("longest_repeat") * 100 > n * longest_share)
    return (counted.withColumn("base_failed", failed)
            .withColumn("kept", ~failed & ~(F.col("covered_chars") * 100 > F.col("word_chars") * most_covered) & ~too_long))
