"""Language ID: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else is a gap; n-grams of one to three
characters (none with a gap in the middle, no lone gap) are hashed to 2^15
buckets. Every task adds up its own count matrix (languages x buckets); their
sum gives log probabilities, a matrix whose size the number of languages bounds
(``max_languages``, checked), which is broadcast. Scoring gathers matrix rows of
a batch's n-grams and adds them up per document, in numpy.

Defined results: ``und`` with score 0 where the text is null, empty or has no
letter, and for every text if no language was learned; rows with a null id are
in the learning part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sums
from .common import chunks, fold, rows_of

BITS, BLOCK = 15, 1024
_LETTERS: list[np.ndarray] = []
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, their rows, and whether each text has a letter."""
    low = [(t or "").lower() for t in texts]
    row = rows_of(np.fromiter(map(len, low), np.int64, len(low)))
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    c = np.where(letter, code, 0).astype(np.uint64)
    has = np.bincount(row[letter], minlength=len(low)) > 0
    buckets, rows = [], []
    value = np.zeros(len(c), np.uint64)
    for n in (1, 2, 3):
        if len(c) < n:
            break
        value = value[:len(c) - n + 1] * np.uint64(_ODD[0]) + c[n - 1:]
        ok = row[n - 1:] == row[:len(row) - n + 1]
        if n == 1:
            ok &= letter
        elif n == 2:
            ok &= letter[1:] | letter[:-1]
        else:
            ok &= letter[1:-1]
        h = (value[ok] + np.uint64(n)) * np.uint64(_ODD[1])
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_ODD[2])
        buckets.append((h >> np.uint64(64 - BITS)).astype(np.int32))
        rows.append(row[:len(row) - n + 1][ok])
    return np.concatenate(buckets), np.concatenate(rows), has


def _texts(batches):
    """Sub-batches of bounded text size, with their texts."""
    for batch in batches:
        sizes = np.zeros(len(batch) + 1, np.int64)
        np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column("text")], out=sizes[1:])
        for a, b in chunks(sizes, 1 << 20):
            part = batch.slice(a, b - a)
            yield part, part.column("text").to_pylist()


def _count_batches(batches):
    counts: dict[str, np.ndarray] = {}
    for batch, texts in _texts(batches):
        langs = np.array(batch.column("lang").to_pylist(), object)
        bucket, row, _ = ngrams(texts)
        for lang in set(langs.tolist()):
            one = np.bincount(bucket[(langs == lang)[row]], minlength=1 << BITS)
            counts[lang] = counts.get(lang, 0) + one
    for lang, one in counts.items():
        yield sums.rows({f"{b}:{lang}": one[b * BLOCK:(b + 1) * BLOCK] for b in range((1 << BITS) // BLOCK)},
                        TaskContext.get().partitionId())


class Languages:
    def __init__(self, names: list[str], logs: np.ndarray):
        self.names, self.logs = names, logs  # logs: buckets x languages

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        bucket, row, has = ngrams(texts)
        total = np.stack([np.bincount(row, self.logs[bucket, k], len(texts)) for k in range(len(self.names))], axis=1)
        best = total.argmax(axis=1)
        share = 1 / np.exp(np.clip(total - total.max(axis=1, keepdims=True), -700, 0)).sum(axis=1)
        return [self.names[k] if h else "und" for k, h in zip(best, has, strict=True)], np.where(has, share, 0.0)


def fit(rows: DataFrame, max_languages: int = 300, smoothing: float = 0.5) -> Languages | None:
    """Rows (lang, text) with a language, to log probabilities; ties between languages go to the first name."""
    n = rows.select("lang").distinct().limit(max_languages + 1).count()
    if n > max_languages:
        raise ValueError(f"more than {max_languages} languages: the broadcast matrix has no bound")
    if not n:
        return None
    parts = sums.collected(rows.mapInArrow(_count_batches, sums.SCHEMA))
    names = sorted({k.partition(":")[2] for k in parts})
    counts = np.stack([np.concatenate([parts[f"{b}:{lang}"] for b in range((1 << BITS) // BLOCK)]) for lang in names], axis=1)
    p = counts + smoothing
    return Languages(names, np.log(p / p.sum(axis=0)).astype(np.float32))


def _predicted(model):
    def run(batches):
        for batch, texts in _texts(batches):
            names, score = ([], np.zeros(0)) if not texts else model.value.predict(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(names, pa.string()),
                                              pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def languages(docs: DataFrame, modulus: int = 4, kept_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang)."""
    flagged = docs.select("doc_id", "text", "lang", fold(F.col("doc_id"), modulus, kept_out).alias("held_out"))
    model = fit(flagged.where("not held_out and lang is not null and text is not null").select("lang", "text"))
    if model is None:
        return flagged.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.lit("und").alias("lang_pred"),
                              F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return flagged.select("doc_id", "held_out", "text").mapInArrow(
        _predicted(shared), "doc_id long, held_out boolean, lang_pred string, score double")
