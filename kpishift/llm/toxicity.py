"""Toxicity: a factorization machine over hashed terms.

Terms are lower-cased words, hashed to 2^18 buckets; a document has a bucket or
not, however long it is. A machine of linear weights and low-rank pairwise
weights scores the set: a pair of terms can be toxic where neither is.

The texts are read once and their bucket sets written. Buckets are counted by
label over all labelled rows outside the held-out fold (at most 2^18 counts).
Those that depend on the label (chi-square) are inputs of the machine, and so are the two buckets of
every pair whose rows bear the label otherwise than the two alone let
expect; pairs are tried among the ``max_pairs`` buckets that depend most on the label or, of the others, are the most
frequent. All other buckets have a linear weight only, their log-odds, shrunk towards 0 as
far as chance explains them. The machine is fitted, and pairs are tried, on the driver on at most about ``max_rows`` of
the labelled rows, chosen by a hash of the id (documented bound).

Defined results: a null text is an empty text and gets the machine's base
score; every row is scored; without any label, or with one class only, the
score is the share of label 1 (0 without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, label_of, rows_of, saved, text_chunks, word_hashes

BITS = 18


def _term_batches(batches):
    for batch, offsets, data in text_chunks(batches):
        h, first = word_hashes(data, offsets)
        row = rows_of(np.diff(first))
        key = np.unique((row << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64))
        places = np.searchsorted(key >> BITS, np.arange(len(batch) + 1)).astype(np.int32)
        terms = pa.ListArray.from_arrays(pa.array(places), pa.array((key & ((1 << BITS) - 1)).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), terms],
                                         names=["doc_id", "held_out", "terms"])


class Machine:
    """Linear weights ``w`` of all buckets; pairwise weights ``v`` of the buckets ``pairs`` (sorted)."""

    def __init__(self, base: float, w: np.ndarray, pairs: np.ndarray, v: np.ndarray):
        self.base, self.w, self.v = base, w, v
        self.place = np.full(len(w), -1, np.int32)
        self.place[pairs] = np.arange(len(pairs))

    def score(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Scores of n sets given as (row, bucket) items."""
        s = np.full(n, self.base) + np.bincount(row, self.w[term], n)
        place = self.place[term]
        row, place = row[place >= 0], place[place >= 0]
        for f in range(self.v.shape[1]):
            x = self.v[place, f]
            s += 0.5 * (np.bincount(row, x, n) ** 2 - np.bincount(row, x * x, n))
        return _sigmoid(s)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _blocks(row: np.ndarray, term: np.ndarray, y: np.ndarray, size: int, rng) -> list[tuple]:
    """The rows in random blocks: (row in the block, index among its terms, its terms, labels)."""
    first = np.searchsorted(row, np.arange(len(y) + 1))
    order = rng.permutation(len(y))
    out = []
    for at in range(0, len(y), size):
        some = order[at:at + size]
        n = first[some + 1] - first[some]
        items = np.repeat(first[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
        terms, inverse = np.unique(term[items], return_inverse=True)
        out.append((rows_of(n), inverse, terms, y[some]))
    return out


def train(row: np.ndarray, term: np.ndarray, y: np.ndarray, prior: np.ndarray, rank: int = 8, epochs: int = 30,
          rate: float = 0.1, decay: float = 1e-5, seed: int = 3) -> Machine:
    """Log loss by Adagrad over (row, bucket) items, sorted by row, in at least 900 steps; ``prior`` weighs all other buckets."""
    rng = np.random.default_rng(seed)
    used, term = np.unique(term, return_inverse=True)
    share = y.mean()
    base, w, v = np.log(share / (1 - share)), np.zeros(len(used)), rng.normal(0, 0.02, (len(used), rank))
    gb, gw, gv = 1e-2, np.full(w.shape, 1e-6), np.full(v.shape, 1e-4)
    blocks = _blocks(row, term, y, 512, rng)
    for _ in range(max(epochs, -(-900 // len(blocks)))):
        for i in rng.permutation(len(blocks)):
            r, at, terms, truth = blocks[i]
            n, k, vt = len(truth), len(terms), v[terms]
            s = base + np.bincount(r, w[terms][at] - 0.5 * (vt * vt).sum(axis=1)[at], n)
            sums = np.stack([np.bincount(r, vt[at, f], n) for f in range(rank)], axis=1)
            g = (_sigmoid(s + 0.5 * (sums * sums).sum(axis=1)) - truth) / n
            gi = g[r]
            dw = np.bincount(at, gi, k)
            dv = np.stack([np.bincount(at, gi * sums[r, f], k) for f in range(rank)], axis=1) - dw[:, None] * vt + decay * vt
            dw += decay * w[terms]
            gb += g.sum() ** 2
            gw[terms] += dw ** 2
            gv[terms] += dv ** 2
            base -= rate * g.sum() / np.sqrt(gb)
            w[terms] -= rate * dw / np.sqrt(gw[terms])
            v[terms] -= rate * dv / np.sqrt(gv[terms])
    weights = prior.astype(float)
    weights[used] = w
    return Machine(float(base), weights, used, v)


def counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows, and rows of label 1, of every bucket, over all rows (terms, label)."""
    seen = (rows.select(F.explode("terms").alias("term"), "label").groupBy("term")
            .agg(F.count("*").cast("double").alias("a"), F.sum("label").cast("double").alias("t")).toArrow())
    a, t = np.zeros(1 << BITS), np.zeros(1 << BITS)
    a[seen.column("term").to_numpy()], t[seen.column("term").to_numpy()] = seen.column("a").to_numpy(), seen.column("t").to_numpy()
    return a, t


def chi_squares(a: np.ndarray, t: np.ndarray, n: int, share: float) -> np.ndarray:
    return (t - a * share) ** 2 / np.maximum(a * share * (1 - share) * np.maximum(1 - a / n, 1e-12), 1e-12)


def log_odds(a: np.ndarray, t: np.ndarray, chi: np.ndarray, share: float, chance: float = 3.5) -> np.ndarray:
    """Log-odds of every bucket against the share of label 1, less what ``chance`` standard deviations of its count explain."""
    rate = (t + 10 * share) / (a + 10)
    evidence = np.maximum(0.0, 1 - chance / np.sqrt(np.maximum(chi, 1e-12))) * a / (a + 20)
    return (np.log(rate / (1 - rate)) - np.log(share / (1 - share))) * evidence


def paired(row: np.ndarray, term: np.ndarray, y: np.ndarray, tried: np.ndarray, least: float = 40.0, rows_least: int = 8) -> np.ndarray:
    """Buckets of ``tried`` (sorted) in a pair whose common rows bear label 1 otherwise than both buckets' shares add up to."""
    both, toxic = np.zeros((len(tried), len(tried))), np.zeros((len(tried), len(tried)))
    at = np.minimum(np.searchsorted(tried, term), max(len(tried) - 1, 0))
    hit = tried[at] == term if len(tried) else np.zeros(len(term), bool)
    row, at = row[hit], at[hit]
    for begin in range(0, len(y), 4096):
        x = np.zeros((min(4096, len(y) - begin), len(tried)), np.float32)
        some = (row >= begin) & (row < begin + 4096)
        x[row[some] - begin, at[some]] = 1
        both += x.T @ x
        toxic += x.T @ (x * y[begin:begin + 4096, None].astype(np.float32))
    share, alone = y.mean(), np.diag(toxic) / np.maximum(np.diag(both), 1)
    expected = np.clip(alone[:, None] + alone[None, :] - share, 0.0, 1.0)
    spread = both * np.maximum(expected * (1 - expected), share * (1 - share))
    found = (both >= rows_least) & ((toxic - both * expected) ** 2 >= least * np.maximum(spread, 1e-12))
    np.fill_diagonal(found, False)
    return tried[found.any(axis=1)]


def _items(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of bucket lists."""
    return rows_of(np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()


def _scored(model: Machine | float):
    def run(batches):
        for batch in batches:
            if isinstance(model, float):
                s = np.full(len(batch), model)
            else:
                s = model.score(*_items(batch.column("terms")), len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64())],
                                             names=["doc_id", "held_out", "score"])

    return run


def fit(rows: DataFrame, max_rows: int = 30_000, least: float = 20.0, max_pairs: int = 1_024) -> Machine | float:
    """The machine for rows (doc_id, terms, label)."""
    total = rows.agg(F.count("*").alias("n"), F.avg("label").alias("share")).first()
    if not total["n"] or total["share"] in (0.0, 1.0):
        return float(total["share"] or 0.0)
    parts = 1 << 62
    part = max(1, int(min(1.0, max_rows / total["n"]) * parts))
    some = (rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < F.lit(part)).select("label", "terms")
            .toArrow().combine_chunks())
    y = some.column("label").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return float(total["share"])
    lists = some.column("terms").combine_chunks()
    row, term = _items(lists if isinstance(lists, pa.ListArray) else lists.chunk(0))
    a, t = counts(rows)
    chi = chi_squares(a, t, total["n"], total["share"])
    strong = (a >= 4) & (chi >= least)
    tried = np.lexsort((np.arange(len(a)), -a, np.where(strong, -chi, 0.0)))[:max_pairs]
    inputs = strong.copy()
    inputs[paired(row, term, y, np.sort(tried[a[tried] > 0]))] = True
    prior = np.where(inputs, 0.0, log_odds(a, t, chi, total["share"]))
    kept = inputs[term]
    return train(row[kept], term[kept], y, prior)


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = 4, kept_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; labels (doc_id, toxic) of the fold are never used."""
    terms = saved(docs.select("doc_id", fold(F.col("doc_id"), modulus, kept_out).alias("held_out"), "text")
                  .mapInArrow(_term_batches, "doc_id long, held_out boolean, terms array<int>"), "toxicity-terms")
    known = label_of(labels, "toxic").hint("merge")  # labels grow with the documents: the same plan at every size
    rows = saved(terms.where("not held_out").join(known, F.col("doc_id") == F.col("label_id"))
                 .select("doc_id", "terms", "label"), "toxicity-rows")
    scored = terms.mapInArrow(_scored(fit(rows)), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
