"""Shared helpers: tables, written intermediate tables, vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpishift.session import remove_scratch, scratch_path

#: Bytes of text worked on at once inside a task (one longer text is its own chunk).
CHUNK_BYTES = 1 << 20


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application (their Python may not have it installed)."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="kpishift-code-")) / "kpishift.zip"  # the driver's own copy
        with zipfile.ZipFile(target, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        sc.addPyFile(str(target))
        _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing_shuffles(spark: SparkSession):
    """Shuffle files of queries run inside go when the query ends, not when the driver next collects its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage: what reads it later survives lost executors, and no
    work before it is done twice.
    """
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    with passing_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    for block in _BLOCKS:
        block.add(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kpishift_path = path
    return out


_BLOCKS: list[set[str]] = []


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`saved` that nothing reads any more."""
    for block in _BLOCKS:
        block.discard(df.kpishift_path)
    remove_scratch(df.sparkSession, df.kpishift_path)


@contextmanager
def scratch_block(spark: SparkSession):
    """Tables that :func:`saved` writes inside the block go at its end, but for those given to the function it yields.

    Only where everything that reads them is written by then: later steps,
    and repeats of steps after a lost executor, must not need them.
    """
    made: set[str] = set()
    _BLOCKS.append(made)
    try:
        yield lambda df: made.discard(df.kpishift_path)
    finally:
        _BLOCKS.remove(made)
        for path in made:
            for block in _BLOCKS:
                block.discard(path)
            remove_scratch(spark, path)


def fold(doc_id: Column, modulus: int, kept_out: int) -> Column:
    """Held-out flag: crc32 of the id's decimal text mod ``modulus`` (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == kept_out, F.lit(False))


def label_of(labels: DataFrame, column: str) -> DataFrame:
    """One label per id: null ids and labels are left out, several rows of an id give the largest."""
    return (labels.select(F.col("doc_id").alias("label_id"), F.col(column).cast("int").alias("label"))
            .where("label_id is not null and label is not null")
            .groupBy("label_id").agg(F.max("label").alias("label")))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and the bytes of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0]:at[-1]]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (at least one row)."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def text_chunks(batches, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Sub-batches with their text offsets and bytes, each of bounded size."""
    for batch in batches:
        offsets, data = utf8(batch.column(column))
        for a, b in chunks(offsets):
            yield batch.slice(a, b - a), offsets[a:b + 1] - offsets[a], data[offsets[a]:offsets[b]]
        del batch, offsets, data
    pa.default_memory_pool().release_unused()  # the worker process goes on to other tasks


# --- words -----------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20_240_501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}

#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words: ASCII letters and digits, and everything beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = WORD_BYTES[65:91] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True

#: Bytes of words parted by white space only.
NON_SPACE_BYTES = np.ones(256, bool)
NON_SPACE_BYTES[9:14] = NON_SPACE_BYTES[32] = False


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P such that (P[e] - P[s]) * B^-s is the polynomial hash of data[s:e] (mod 2^64)."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[:len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, the same wherever a span stands."""
    _, down = _powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Words of concatenated texts.

    Returns start, end (byte positions) and first (len(offsets): the words of
    text i are first[i]:first[i + 1]). No word crosses a text boundary.
    """
    inside = is_word[data]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = WORD_BYTES):
    """Hashes of the lower-cased (A-Z) words of each text, and ``first`` as in :func:`words`."""
    low = LOWER[data]
    start, end, first = words(low, offsets, is_word)
    return span_hash(prefix_hash(low), start, end), first


def hash_of(word: str) -> int:
    """Hash of one word, equal to :func:`word_hashes` of it."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(span_hash(prefix_hash(LOWER[raw]), np.array([0]), np.array([len(raw)]))[0])


def rows_of(counts: np.ndarray) -> np.ndarray:
    """Row number of each item, for items counted per row."""
    return np.repeat(np.arange(len(counts)), counts)
