"""Vector codes: product quantisation with integer codebooks, entries found by equal-average search.

Components become integers (floor of ``scale`` times the component), vectors
are cut into ``parts`` equal parts, and every part position has a codebook. It
starts as that part of the ``entries`` vectors of least id (null ids last, equal ids by
their components); each round assigns every part to its nearest entry and
replaces each entry by the mean of its parts, rounded down. Entries without
parts stay. Then all parts are assigned once more.

Search: entries are sorted by the sum of their components. The squared gap of
two sums over the number of components is at most the squared distance, so the
search starts at a part's own sum, goes outward to the nearer sum next, and ends
where that bound is strictly greater than the best distance (an equal one could
be a tie of lower index). All arithmetic is in integers and exact.

A round is one pass over the vectors: each task adds up its parts by entry, the
sums are added up by Spark, and the driver gets ``parts x entries`` rows of them,
whatever the number of vectors. No vector is shuffled.

Rows whose vector is null, or holds a null, NaN or infinite component, are left
out. So are vectors whose length is no positive multiple of ``parts``, or not that
of the first vector (by id) of such a length. Fewer vectors than ``entries`` give fewer entries; no
vector, no row. Repeated rows count and come out as often as they stand. A component too
large for exact 64-bit distances raises an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, ship

#: Codes are two hexadecimal digits.
MOST_ENTRIES = 256


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) for every row of ``x``; ties go to the lower entry."""
    width = x.shape[1]
    total = book.sum(axis=1)
    order = np.argsort(total, kind="stable")
    total, ordered = total[order], book[order]
    own = x.sum(axis=1)
    right = np.searchsorted(total, own)
    left = right - 1
    far = np.iinfo(np.int64).max
    best, entry = np.full(len(x), far // width), np.full(len(x), len(book))
    live = np.arange(len(x))
    while len(live):
        a, b, mine = left[live], right[live], own[live]
        below = np.where(a >= 0, mine - total[np.maximum(a, 0)], far)
        above = np.where(b < len(book), total[np.minimum(b, len(book) - 1)] - mine, far)
        down = below <= above
        gap = np.where(down, below, above)
        more = gap < far
        more[more] = gap[more] ** 2 <= best[live[more]] * width
        live, down, a, b = live[more], down[more], a[more], b[more]
        at = np.where(down, a, b)
        off = x[live] - ordered[at]
        distance = np.einsum("ij,ij->i", off, off)
        number = order[at]
        better = (distance < best[live]) | ((distance == best[live]) & (number < entry[live]))
        best[live[better]], entry[live[better]] = distance[better], number[better]
        left[live] -= down
        right[live] += ~down
    return entry, best


def _integers(column: pa.Array, dim: int, scale: float, limit: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(-1, dim)
    if len(x) and abs(x).max() > limit:
        raise ValueError(f"a component is beyond {limit} / {scale}: squared distances would not be exact")
    return x.astype(np.int64)


def _limit(width: int) -> int:
    """Components up to this size keep squared gaps of sums within 64 bits."""
    return (1 << 30) // width - 1


def _sum_batches(books: np.ndarray, scale: float, dim: int):
    parts, entries, width = books.shape

    def run(batches):
        count = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            x = _integers(batch.column("embedding"), dim, scale, _limit(width)).reshape(-1, parts, width)
            for p in range(parts):
                entry, _ = nearest(x[:, p], books[p])
                count[p] += np.bincount(entry, minlength=entries)
                np.add.at(sums[p], entry, x[:, p])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), *(pa.array(sums[p, e, i]) for i in range(width))],
            names=["part", "entry", "n", *(f"s{i}" for i in range(width))])

    return run


def _code_batches(books: np.ndarray, scale: float, dim: int):
    parts, _, width = books.shape
    digits = np.array([f"{i:02x}" for i in range(MOST_ENTRIES)])

    def run(batches):
        for batch in batches:
            x = _integers(batch.column("embedding"), dim, scale, _limit(width)).reshape(-1, parts, width)
            error, code = np.zeros(len(x), np.int64), np.zeros(len(x), "U1")
            for p in range(parts):
                entry, distance = nearest(x[:, p], books[p])
                error += distance
                code = digits[entry] if p == 0 else np.char.add(code, digits[entry])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(code.tolist(), pa.string()), pa.array(error)],
                names=["vec_id", "label", "code", "error"])

    return run


def fit_codebooks(kept: DataFrame, dim: int, parts: int, entries: int, rounds: int, scale: float) -> np.ndarray:
    """Final entries as integers (part, entry, position)."""
    width = dim // parts
    first = _first(kept.where(F.size("embedding") == dim), entries)
    start = _integers(pa.array([r["embedding"] for r in first], pa.list_(pa.float64())), dim, scale, _limit(width))
    books = start.reshape(-1, parts, width).transpose(1, 0, 2).copy()
    schema = "part int, entry int, n long, " + ", ".join(f"s{i} long" for i in range(width))
    for _ in range(rounds):
        rows = (kept.where(F.size("embedding") == dim).select("embedding").mapInArrow(_sum_batches(books, scale, dim), schema)
                .groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(width))))
        books = books.copy()
        for r in rows.collect():  # at most parts x entries
            books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return books


def _first(kept: DataFrame, n: int) -> list:
    return kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(n).collect()


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256) -> DataFrame:
    """vec_id, label, code, error, label_error (errors added up over equal labels, nulls together), codebooks_sha256."""
    if not 0 < entries <= MOST_ENTRIES:
        raise ValueError(f"entries must be between 1 and {MOST_ENTRIES}")
    spark = vectors.sparkSession
    ship(spark)
    kept = (vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
            .where("embedding is not null and forall(embedding, x -> x is not null and abs(x) < double('infinity'))")
            .where((F.size("embedding") > 0) & (F.size("embedding") % parts == 0)))
    head = _first(kept, 1)
    schema = T.StructType([kept.schema["vec_id"], kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not head:
        return spark.createDataFrame([], schema).select("*", F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    dim = len(head[0]["embedding"])
    books = fit_codebooks(kept, dim, parts, entries, rounds, scale)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    coded = saved(kept.where(F.size("embedding") == dim).mapInArrow(_code_batches(books, scale, dim), schema), "codes")
    # written, so that its size is known: Spark broadcasts it if it is small, else joins by a shuffle and splits hot labels
    totals = saved(coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "codes-labels")
    return (coded.join(totals, F.col("label").eqNullSafe(F.col("of_label")))
            .select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))
