"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Each text becomes about two dozen statistics (lengths, shares of byte classes,
repetition). Standardised, they pass through random Fourier features, which
approximate a Gaussian kernel. Every task adds up the normal equations of its
labelled rows; their sum (``width`` squared, whatever the row count) is solved
on the driver. Ridge scores of the labelled rows are counted in fixed bins and
calibrated by pool-adjacent-violators. All labelled rows outside the held-out
fold are used; the texts are read once, the statistics are written.

Defined results: a null text is an empty text; every row gets a score (also
rows with a null or repeated id); without any label the score is 0.5, with one
class only it is that class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sums
from .common import LOWER, NON_SPACE_BYTES, fold, label_of, prefix_hash, rows_of, saved, span_hash, text_chunks, words

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t", "line_end": b"\n\r",
            "stop": b".,;:?'\"-()", "bang": b"!", "bar": b"|", "symbol": b"#$%&*+=<>@^_~/\\{}[]`"}
N_FEATURES = len(_CLASSES) + 1 + 14
BINS = 2000


def _ratio(a, b):
    return a / np.maximum(b, 1)


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repetition(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct hashes per row, and the largest count of one hash."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, row))
    hs, rs = h[order], row[order]
    start = np.flatnonzero(np.concatenate([[True], (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])]))
    counts = np.diff(np.append(start, len(hs)))
    most = np.zeros(n)
    np.maximum.at(most, rs[start], counts)
    return np.bincount(rs[start], minlength=n).astype(float), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x N_FEATURES."""
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)
    shares = []
    for members in (*_CLASSES.values(), bytes(range(128, 256))):
        lut = np.zeros(256, bool)
        lut[list(members)] = True
        shares.append(_ratio(_per_row(lut[data], offsets), size))
    start, end, first = words(data, offsets, NON_SPACE_BYTES)
    count = np.diff(first)
    row, length = rows_of(count), (end - start).astype(float)
    prefix = prefix_hash(LOWER[data])
    h = span_hash(prefix, start, end)
    total = np.bincount(row, length, n)
    spread = np.sqrt(np.maximum(0, _ratio(np.bincount(row, length ** 2, n), count) - _ratio(total, count) ** 2))
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    distinct, most = _repetition(h, row, n)
    twin = np.zeros(len(h), bool)
    twin[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    capital = (data[start] >= 65) & (data[start] <= 90) if len(start) else np.zeros(0, bool)
    odd = np.zeros(256, bool)
    odd[list(b"!|#$%&*+=<>@^_~/\\{}[]`")] = True
    tail = odd[data[end - 1]] if len(end) else np.zeros(0, bool)
    not_end = np.ones(256, bool)
    not_end[10] = False
    l_start, l_end, l_first = words(data, offsets, not_end)
    lines = np.diff(l_first)
    l_distinct, _ = _repetition(span_hash(prefix, l_start, l_end), rows_of(lines), n)
    sentences = _per_row(np.isin(data, np.frombuffer(b".!?", np.uint8)), offsets)
    columns = [*shares, np.log1p(size), np.log1p(count), _ratio(total, count), spread, np.log1p(longest),
               _ratio(distinct, count), _ratio(most, count), _ratio(np.bincount(row, twin, n), count),
               _ratio(np.bincount(row, capital, n), count), _ratio(np.bincount(row, tail, n), count),
               np.log1p(lines), _ratio(l_distinct, lines), np.log1p(_ratio(count, lines)), np.log1p(_ratio(count, sentences))]
    return np.stack(columns, axis=1)


def _statistic_batches(batches):
    """Any columns but ``text`` as they are, and the statistics ``x``."""
    for batch, offsets, data in text_chunks(batches):
        x = statistics(data, offsets).astype(np.float32)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), N_FEATURES).cast(pa.list_(pa.float32()))
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists], names=[*names, "x"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().astype(float).reshape(len(batch), -1)


class Model:
    """Scores for statistics; plain arrays, a few hundred KB."""

    def __init__(self, mean, scale, width: int, bandwidth: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.width = mean, scale, width
        self.w = rng.normal(0, 1 / (bandwidth * np.sqrt(len(mean))), (len(mean), width))
        self.b = rng.uniform(0, 2 * np.pi, width)
        self.beta = None
        self.knots = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / self.width) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.knots)


def isotonic(centers: np.ndarray, positives: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over binned scores: knots of a non-decreasing curve."""
    pools: list[list[float]] = []  # positives, count, first center, last center
    for c, p, n in zip(centers, positives, counts, strict=True):
        pools.append([p, n, c, c])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            p2, n2, _, last = pools.pop()
            pools[-1][0] += p2
            pools[-1][1] += n2
            pools[-1][3] = last
    xs, ys = [], []
    for p, n, lo, hi in pools:
        xs += [lo, hi] if hi > lo else [lo]
        ys += [p / n] * (2 if hi > lo else 1)
    return np.array(xs), np.array(ys)


def _equations(model: Model):
    def run(batches):
        gram = np.zeros((model.width + 1, model.width + 2))
        for batch in batches:
            z = model.features(_matrix(batch))
            y = batch.column("label").to_numpy().astype(float)
            gram += z.T @ np.column_stack([z, y])
        yield sums.rows({f"{i}": r for i, r in enumerate(gram)}, TaskContext.get().partitionId())

    return run


def _binned(model: Model):
    def run(batches):
        counts = np.zeros((2, BINS))
        for batch in batches:
            at = np.clip(((model.raw(_matrix(batch)) + 0.5) * BINS / 2).astype(int), 0, BINS - 1)
            y = batch.column("label").to_numpy().astype(float)
            counts += [np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)]
        yield sums.rows({"positives": counts[0], "counts": counts[1]}, TaskContext.get().partitionId())

    return run


def fit(rows: DataFrame, width: int = 300, ridge: float = 1e-3, bandwidth: float = 0.6, seed: int = 5) -> Model | float:
    """A model of rows (x, label); the share of label 1 where there is only one class (0.5 without rows)."""
    columns = [F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(N_FEATURES)]
    columns += [F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(N_FEATURES)]
    first = rows.agg(F.count("*").alias("n"), F.avg("label").alias("share"), *columns).first()
    if not first["n"] or first["share"] in (0.0, 1.0):
        return float(first["share"]) if first["n"] else 0.5
    scale = np.array([first[f"s{i}"] for i in range(N_FEATURES)])
    model = Model(np.array([first[f"m{i}"] for i in range(N_FEATURES)]), np.where(scale > 1e-9, scale, 1.0), width, bandwidth, seed)
    parts = sums.collected(rows.select("x", "label").mapInArrow(_equations(model), sums.SCHEMA))
    gram = np.stack([parts[f"{i}"] for i in range(width + 1)])
    model.beta = np.linalg.solve(gram[:, :-1] + ridge * first["n"] / width * np.eye(width + 1), gram[:, -1])
    bins = sums.collected(rows.select("x", "label").mapInArrow(_binned(model), sums.SCHEMA))
    some = bins["counts"] > 0
    centers = (np.arange(BINS) + 0.5) * 2 / BINS - 0.5
    model.knots = isotonic(centers[some], bins["positives"][some], bins["counts"][some])
    return model


def _scored(model: Model | float):
    def run(batches):
        for batch in batches:
            s = np.full(len(batch), model) if isinstance(model, float) else model.score(_matrix(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.clip(s, 0, 1))],
                                             names=["doc_id", "held_out", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 3, kept_out: int = 1, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; labels (doc_id, quality) of the fold are never used."""
    x = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold(F.col("doc_id"), modulus, kept_out).alias("held_out"), "text")
              .mapInArrow(_statistic_batches, "doc_id long, held_out boolean, x array<float>"), "quality-statistics")
    rows = saved(x.where("not held_out").join(label_of(labels, "quality"), F.col("doc_id") == F.col("label_id"))
                 .select("x", "label"), "quality-rows")
    scored = x.mapInArrow(_scored(fit(rows)), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _passing(model: Model | float, threshold: float):
    def run(batches):
        for batch, offsets, data in text_chunks(batches):
            x = statistics(data, offsets)
            s = np.full(len(batch), model) if isinstance(model, float) else model.score(x.astype(np.float32).astype(float))
            yield batch.filter(pa.array(s >= threshold))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, modulus: int = 3, kept_out: int = 1, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (all columns) whose score reaches the threshold; each row is scored for itself, without a join."""
    learning = docs.select("doc_id", "text").where(~fold(F.col("doc_id"), modulus, kept_out)).join(
        label_of(labels, "quality"), F.col("doc_id") == F.col("label_id"))
    rows = saved(learning.select("label", "text").mapInArrow(_statistic_batches, "label int, x array<float>"), "quality-rows")
    return docs.mapInArrow(_passing(fit(rows), threshold), docs.schema)
