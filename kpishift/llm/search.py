"""Exact BM25 top-k: inverted index per shard, block-max pruning, exact merge.

Index: each scan task cuts its documents into shards (bounded in rows and
bytes) and writes, per shard, a term dictionary, postings (document, count) and
document lengths. Documents of a shard are ordered by their commonest word, so
blocks of neighbours are alike and block maxima are tight.

Statistics are global: number of documents, mean length and document frequency
of every query term over all shards, so scores do not depend on the sharding.

Search: queries go in blocks of bounded size; every block is broadcast and run
against every shard. Shards are visited in groups of about 8, 64, 512 ...; the
k-th best score that a query has found so far goes with it to the next group,
which returns nothing below it, so a query gets back a few times k rows from a
group, however many shards it has. Within a shard, block-max WAND runs for many queries at
once. Lists of rare terms are added up document by document. For common terms a
matrix of block maxima gives each query's upper bound in each block; a block
whose bound, with the best rare-term sum in it, is below the query's current
k-th score is skipped, the others are scored in full. A task carries its k-th
scores on from shard to shard and returns at most k rows a query; the merge
keeps the best k of all tasks.

score = sum over query words (each as often as it occurs in the query) of
ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length)),
rounded to 6 digits. Equal scores rank by document id.

Defined results: a query without words, or whose words occur nowhere, has no
rows; documents without words are never found; null ids are null in the result
and rank first among equals; repeated rows are found each for itself; query
rows that share an id are one query.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of, saved, text_chunks, word_hashes

SHARD_SCHEMA = ("shard long, n int, n_words long, doc_ids array<long>, lengths binary, terms binary, first binary, docs binary, counts binary")
_SHARDS = pa.schema([("shard", pa.int64()), ("n", pa.int32()), ("n_words", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()),
                     ("terms", pa.binary()), ("first", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary())])
_NO_ID = np.iinfo(np.int64).min


def term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of each text's distinct words, and the texts' lengths in words."""
    h, first = word_hashes(data, offsets)
    lengths = np.diff(first)
    row = rows_of(lengths)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(new)
    return row[start], h[start], np.diff(np.append(start, len(h))), lengths


class _Shard:
    def __init__(self):
        self.rows, self.terms, self.counts, self.lengths, self.ids, self.bytes = [], [], [], [], [], 0

    def add(self, ids, row, term, count, lengths, size):
        self.rows.append(row + sum(map(len, self.lengths)))
        self.terms.append(term)
        self.counts.append(count)
        self.lengths.append(lengths)
        self.ids += ids
        self.bytes += size

    def batch(self, number: int) -> pa.RecordBatch:
        row, term, count = map(np.concatenate, (self.rows, self.terms, self.counts))
        lengths = np.concatenate(self.lengths)
        n = len(lengths)
        common = np.zeros(n, np.uint64)  # each document's commonest word
        order = np.lexsort((term, count))
        common[row[order]] = term[order]
        rank = np.lexsort((lengths, common))
        place = np.empty(n, np.int64)
        place[rank] = np.arange(n)
        order = np.lexsort((place[row], term))
        term, doc, count = term[order], place[row][order], count[order]
        new = np.ones(len(term), bool)
        new[1:] = term[1:] != term[:-1]
        start = np.flatnonzero(new)
        cells = [(np.take(lengths, rank), np.int32), (term[start], np.uint64), (np.append(start, len(term)), np.int32),
                 (doc, np.uint16), (count, np.uint32)]
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([n], pa.int32()), pa.array([int(lengths.sum())], pa.int64()), pa.array([[self.ids[i] for i in rank]], pa.list_(pa.int64())),
             *(pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in cells)], schema=_SHARDS)


def _shard_batches(max_docs: int, max_bytes: int):
    def run(batches):
        shard, number = _Shard(), TaskContext.get().partitionId() << 32
        for batch, offsets, data in text_chunks(batches):
            ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            for a in range(0, len(batch), max_docs):
                part = offsets[a:a + max_docs + 1]
                if len(shard.ids) + len(part) - 1 > max_docs or (shard.ids and shard.bytes + part[-1] - part[0] > max_bytes):
                    yield shard.batch(number)
                    shard, number = _Shard(), number + 1
                shard.add(ids[a:a + len(part) - 1], *term_counts(data[part[0]:part[-1]], part - part[0]), int(part[-1] - part[0]))
        if shard.ids:
            yield shard.batch(number)

    return run


def build_index(docs: DataFrame, max_docs: int = 4096, max_bytes: int = 16 << 20) -> DataFrame:
    """One row per shard, written to the shared folder (max_docs at most 65536)."""
    return saved(docs.select("doc_id", "text").mapInArrow(_shard_batches(max_docs, max_bytes), SHARD_SCHEMA), "search-index")


def _array(value, kind) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _dictionary_batches(batches):
    for batch in batches:
        for terms, first in zip(batch.column("terms"), batch.column("first"), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(_array(terms, np.int64)), pa.array(np.diff(_array(first, np.int32)).astype(np.int64))],
                                             names=["term", "df"])


def _query_batches(batches):
    for batch, offsets, data in text_chunks(batches):
        row, term, count, _ = term_counts(data, offsets)
        yield pa.RecordBatch.from_arrays([batch.column("query_id").cast(pa.int64()).take(pa.array(row)), pa.array(term.view(np.int64)),
                                          pa.array(count.astype(np.int64))], names=["query_id", "term", "qtf"])


class Queries:
    """A block of queries: ids, and (query, term, weight) items sorted by query."""

    def __init__(self, table: pa.Table):
        ids, self.query = np.unique(table.column("query_id").to_numpy(), return_inverse=True)
        self.ids = ids
        order = np.argsort(self.query, kind="stable")
        self.query = self.query[order].astype(np.int32)
        self.weight = table.column("weight").to_numpy()[order]
        self.terms, self.term = np.unique(table.column("term").to_numpy()[order].view(np.uint64), return_inverse=True)


class Best:
    """The best k (score, document) of each query so far; by score, then id.

    ``floor``: k-th best scores found elsewhere; nothing below them is wanted.
    """

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.floor = np.zeros(queries) if floor is None else floor
        self.score = np.zeros((queries, k))
        self.doc = np.full((queries, k), np.iinfo(np.int64).max)

    def merge(self, at: np.ndarray, score: np.ndarray, doc: np.ndarray):
        score, doc = np.hstack([self.score[at], score]), np.hstack([self.doc[at], doc])
        first = np.argsort(doc, axis=1, kind="stable")
        score, doc = np.take_along_axis(score, first, 1), np.take_along_axis(doc, first, 1)
        top = np.argsort(-score, axis=1, kind="stable")[:, :self.k]
        self.score[at], self.doc[at] = np.take_along_axis(score, top, 1), np.take_along_axis(doc, top, 1)

    def least(self, at: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[at, -1], self.floor[at])


def search_shard(shard: dict, queries: Queries, best: Best, k1: float, b: float, mean: float, block: int = 128, group: int = 256):
    """Run all queries of a block against one shard."""
    n = shard["n"]
    terms, first = shard["terms"], shard["first"]
    if not len(terms) or not len(queries.terms):
        return
    df = np.diff(first)
    impact = shard["counts"] * (k1 + 1) / (shard["counts"] + k1 * (1 - b + b * shard["lengths"][shard["docs"]] / mean))
    at = np.minimum(np.searchsorted(terms, queries.terms), len(terms) - 1)
    local = np.where(terms[at] == queries.terms, at, -1)  # query term -> shard term
    known = local >= 0
    is_common = np.zeros(len(local), bool)
    is_common[known] = df[local[known]] * 32 >= n
    common = np.flatnonzero(is_common)
    column = np.full(len(local), -1)
    column[common] = np.arange(len(common))
    blocks = -(-n // block)
    dense = np.zeros((len(common), blocks * block))
    for j, t in enumerate(local[common]):
        dense[j, shard["docs"][first[t]:first[t + 1]]] = impact[first[t]:first[t + 1]]
    peak = dense.reshape(len(common), blocks, block).max(axis=2)
    rank = np.empty(n)
    rank[np.argsort(shard["doc_ids"], kind="stable")] = np.arange(n)
    edge = np.searchsorted(queries.query, np.arange(0, len(queries.ids) + group, group))
    for g, (lo, hi) in enumerate(zip(edge, edge[1:], strict=False)):
        size = min(group, len(queries.ids) - g * group)
        mine = np.arange(g * group, g * group + size)
        query, term, weight = queries.query[lo:hi] - g * group, queries.term[lo:hi], queries.weight[lo:hi]
        heavy = column[term] >= 0
        w = np.zeros((size, len(common)))
        w[query[heavy], column[term[heavy]]] = weight[heavy]
        light = ~heavy & (local[term] >= 0)
        t = local[term[light]]
        length = df[t]
        posting = np.repeat(first[t] - np.cumsum(length) + length, length) + np.arange(length.sum())
        cell = np.repeat(query[light].astype(np.int64), length) * (blocks * block) + shard["docs"][posting]
        score = np.bincount(cell, np.repeat(weight[light], length) * impact[posting], size * blocks * block)
        score = score.astype(float).reshape(size, -1)  # no items: counts come as integers
        least = best.least(mine)
        bound = w @ peak + score.reshape(size, blocks, block).max(axis=2)
        alive = (bound >= least[:, None] - 1e-5) & (bound > 0)
        for j in np.flatnonzero(alive.any(axis=0)):
            q = np.flatnonzero(alive[:, j])
            score[q, j * block:(j + 1) * block] += w[q] @ dense[:, j * block:(j + 1) * block]
        dead = np.repeat(~alive, block, axis=1)[:, :n]
        score = score[:, :n]
        score[dead] = 0
        score = np.round(score, 6)
        keyed = np.where(score > 0, score - rank * 1e-10, -1.0)
        k = min(best.k, n)
        top = np.argpartition(-keyed, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (size, 1))
        found = np.take_along_axis(score, top, 1)
        ids = np.where(found > 0, shard["doc_ids"][top], np.iinfo(np.int64).max)
        some = np.flatnonzero((found >= least[:, None]).any(axis=1) & (found > 0).any(axis=1))
        if len(some):
            best.merge(mine[some], found[some], ids[some])


def _search_batches(shared, k: int, k1: float, b: float, mean: float):
    def run(batches):
        queries, floor = shared.value
        best = None
        for batch in batches:
            for i in range(len(batch)):
                if best is None:
                    best = Best(len(queries.ids), k, floor)
                ids = np.array([_NO_ID if x is None else x for x in batch.column("doc_ids")[i].as_py()], np.int64)
                shard = {"n": batch.column("n")[i].as_py(), "doc_ids": ids}
                for name, kind in (("lengths", np.int32), ("terms", np.uint64), ("first", np.int32), ("docs", np.uint16), ("counts", np.uint32)):
                    shard[name] = _array(batch.column(name)[i], kind)
                search_shard(shard, queries, best, k1, b, mean)
        if best is not None:
            q, j = np.nonzero((best.score > 0) & (best.score >= floor[:, None]))
            doc = best.doc[q, j]
            yield pa.RecordBatch.from_arrays([pa.array(queries.ids[q]), pa.array(doc, mask=doc == _NO_ID), pa.array(best.score[q, j])],
                                             names=["query_id", "doc_id", "score"])

    return run


def bm25_search(index: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75,
                block_terms: int = 2_000_000) -> DataFrame:
    """query_id, rank, doc_id, score: the k best documents of the index for each query (query_id, text).

    ``block_terms`` bounds the distinct words of the queries of one block, which is what a task holds.
    """
    spark = index.sparkSession
    total = index.agg(F.sum("n").alias("n"), F.sum("n_words").alias("words"), F.count("*").alias("shards")).first()
    schema = "query_id long, rank int, doc_id long, score double"
    if not total["words"]:
        return spark.createDataFrame([], schema)
    n = float(total["n"])
    df = index.select("terms", "first").mapInArrow(_dictionary_batches, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    asked = (queries.where("query_id is not null").select("query_id", "text")
             .mapInArrow(_query_batches, "query_id long, term long, qtf long").groupBy("query_id", "term").agg(F.sum("qtf").alias("qtf")))
    weighted = saved(asked.join(df, "term").select(
        "query_id", "term", (F.col("qtf") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("weight")), "search-queries")
    blocks = max(1, -(-weighted.count() // block_terms))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    spread = F.pmod(F.xxhash64("shard"), F.lit(1 << 20)) / F.lit(float(1 << 20))  # a shard's place in [0, 1)
    parts = []
    for block in range(blocks):  # a stated query set against all rows, in blocks
        queries = Queries(weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow())
        floor, found, low, size = np.zeros(len(queries.ids)), None, 0.0, 8
        while low < 1:
            high = min(1.0, low + size / total["shards"])
            shared = spark.sparkContext.broadcast((queries, floor))
            group = saved(index.where((spread >= low) & (spread < high)).mapInArrow(
                _search_batches(shared, k, k1, b, total["words"] / n), "query_id long, doc_id long, score double"), "search-found")
            found = group if found is None else found.union(group)
            found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc_id", "score")
            low, size = high, size * 8
            if low < 1:  # at most one row for each query of the block
                kth = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).toArrow()
                floor = np.zeros(len(queries.ids))
                floor[np.searchsorted(queries.ids, kth.column("query_id").to_numpy())] = kth.column("score").to_numpy()
        parts.append(found)
    every = functools.reduce(DataFrame.union, parts)
    return (every.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "doc_id", "score"))
