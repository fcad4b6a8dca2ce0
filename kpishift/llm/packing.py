"""Packing: concatenate all documents' ids and cut into fixed windows.

Two passes. The first encodes each scan partition, gives every document its
place within the partition, and writes ids and places. A prefix sum over the
partitions' token totals (one row per partition) gives each partition its
global offset. The second pass cuts each document at multiples of ``size``;
a document over a boundary becomes several pieces. Nothing is shuffled but the
totals, and no task holds more than a batch of documents.

Defined results: a null or empty text is its end id alone; rows with the same
id, or with a null id, are packed each for itself; an empty table gives no
pieces. Only the last window is filled partly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .tokens import encoder

IDS_SCHEMA = "doc_id long, part int, place long, doc_tokens long, ids binary"
PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_IDS = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("place", pa.int64()),
                  ("doc_tokens", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                     ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """One row per document: its ids (end id last) and its place in its partition.

    Ids are little-endian, 2 bytes each if the whole vocabulary fits, else 4.
    """

    def run(batches):
        enc, part, place = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint32)
        kind = "<u2" if max(enc.vocabulary_size, end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            for at in range(0, len(batch), 500):
                some = batch.slice(at, 500)
                ids = [np.append(one, end) for one in enc.encode(some.column("text").to_pylist())]
                lengths = np.fromiter(map(len, ids), np.int64, len(ids))
                places = place + np.cumsum(lengths) - lengths
                place += int(lengths.sum())
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id").cast(pa.int64()), pa.array(np.full(len(ids), part, np.int32)),
                     pa.array(places), pa.array(lengths), pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())],
                    schema=_IDS)

    return docs.select("doc_id", "text").mapInArrow(run, IDS_SCHEMA)


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of documents in windows of ``size`` ids; ``ids`` holds a piece's own ids."""
    ids = saved(encoded(docs, tokenizer, end_id), "packing-ids")
    totals = ids.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    # one row per scan partition: the window and the broadcast are bounded by the number of partitions
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("part").alias("base_part"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = (ids.join(F.broadcast(bases), F.col("part") == F.col("base_part"))
              .select("doc_id", (F.col("base") + F.col("place")).alias("at"), "doc_tokens", "ids"))

    def cut(batches):
        for batch in batches:
            rows, starts, lengths, totals, parts = [], [], [], [], []
            offsets, counts = batch.column("at").to_numpy(), batch.column("doc_tokens").to_pylist()
            for i, (n, one) in enumerate(zip(counts, batch.column("ids"), strict=True)):
                raw = one.as_buffer()
                ids, done = np.frombuffer(raw, f"<u{raw.size // n}").astype("<u4"), 0
                while done < n:
                    step = min(n - done, size - int(offsets[i] + done) % size)
                    rows.append(i)
                    starts.append(done)
                    lengths.append(step)
                    totals.append(n)
                    parts.append(ids[done:done + step].tobytes())
                    done += step
            rows, starts = np.array(rows, np.int64), np.array(starts, np.int64)
            at = offsets[rows] + starts if len(rows) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows)), pa.array(starts), pa.array(lengths, pa.int64()),
                 pa.array(totals, pa.int64()), pa.array(at // size), pa.array(at % size), pa.array(parts, pa.binary())],
                schema=_PIECES)

    return placed.mapInArrow(cut, PIECE_SCHEMA)


def sequences(pieces: DataFrame, size: int = 2048, pad_id: int = 0) -> DataFrame:
    """The windows themselves: ``ids`` of exactly ``size`` ids, the last one padded; ``boundaries`` where pieces begin."""
    pad = F.unhex(F.lit(int(pad_id).to_bytes(4, "little").hex()))
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))  # at most ``size`` pieces a window
    joined = F.aggregate("parts", F.unhex(F.lit("")), lambda a, p: F.concat(a, p["ids"]))
    return (pieces.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length"))
            .select("sequence_id", F.col("length").cast("long").alias("length"),
                    F.expr("transform(parts, p -> p.offset)").alias("boundaries"),
                    F.expr("transform(parts, p -> p.doc_id)").alias("doc_ids"), joined.alias("joined"))
            .withColumn("ids", F.rpad(F.col("joined"), F.lit(4 * size), pad)).drop("joined"))
