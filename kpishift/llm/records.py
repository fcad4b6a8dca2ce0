"""Token-ID / binary output: length-delimited records with masked checksums.

File format, one file per range of ids (all integers little-endian). A record:

    u64 length of the payload | u32 masked checksum of those 8 bytes |
    payload | u32 masked checksum of the payload

Payload: i64 document id (0 where null), u8 1 if there is an id, u8 bytes per
token id (2 if every id of the vocabulary fits, else 4), then the unsigned
token ids, end id last. The checksum is CRC-32 (zlib), masked by rotating it
15 bits to the right and adding 0xA282EAD8. The index is a Parquet table with a
row per record: file, byte offset, payload length, doc_id, n_tokens. Any record
can be read alone at its offset (:func:`read_at`), in any order.

Files are in ascending doc_id order (null first), and so are the records in
each. A task writes under a name of its own; only files named by the committed
index belong to the output, so repeated or lost tasks leave no double records.

Defined results: a null or empty text is its end id alone; rows with the same
id are records of their own (order: text); an empty table gives no records.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import encoder

INDEX_SCHEMA = "part int, file string, offset long, length long, doc_id long, n_tokens long"
RECORD_SCHEMA = "doc_id long, part int, place long, n_tokens long, ids binary"
_INDEX = pa.schema([("part", pa.int32()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
                    ("doc_id", pa.int64()), ("n_tokens", pa.int64())])
_RECORDS = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("n_tokens", pa.int64()),
                      ("ids", pa.binary())])
_HEAD = struct.Struct("<QI")
_ID = struct.Struct("<qBB")


def masked(data) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(stream) -> bytes | None:
    """The next payload; None at the end of the file; ValueError on damage."""
    head = stream.read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size or masked(head[:8]) != _HEAD.unpack(head)[1]:
        raise ValueError("record header is damaged")
    length = _HEAD.unpack(head)[0]
    payload, check = stream.read(length), stream.read(4)
    if len(payload) != length or len(check) != 4 or struct.unpack("<I", check)[0] != masked(payload):
        raise ValueError("record is damaged")
    return payload


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _uri(path: str) -> str:
    return "file://" + path[len("file:"):] if path.startswith("file:/") and not path.startswith("file://") else path


def _payload(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return _ID.pack(doc_id or 0, doc_id is not None, width) + ids.astype(f"<u{width}").tobytes()


def _ids_of(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, known, width = _ID.unpack_from(payload)
    return doc_id if known else None, np.frombuffer(payload, f"<u{width}", offset=_ID.size).astype("<u4")


def read_at(uri: str, offset: int) -> tuple[int | None, np.ndarray]:
    """One record by its place in the index: document id and ids."""
    fs, path = _place(uri)
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return _ids_of(unframe(f))


def write_records(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write ``out_dir/data`` and ``out_dir/index`` (shared storage); returns the index."""
    data_dir = f"{_uri(out_dir).rstrip('/')}/data"

    def run(batches):
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end, out, offset, uri = np.array([end_id], np.uint32), None, 0, ""
        width = 2 if max(enc.vocabulary_size, end_id + 1) <= 1 << 16 else 4
        try:
            for batch in batches:
                for at in range(0, len(batch), 500):
                    some = batch.slice(at, 500)
                    if out is None:
                        uri = f"{data_dir}/part-{part:06d}-{uuid.uuid4().hex}.rec"
                        fs, path = _place(uri)
                        fs.create_dir(path.rpartition("/")[0], recursive=True)
                        out = fs.open_output_stream(path)
                    doc_ids = some.column("doc_id").to_pylist()
                    offsets, lengths, counts = [], [], []
                    for doc_id, ids in zip(doc_ids, enc.encode(some.column("text").to_pylist()), strict=True):
                        payload = _payload(doc_id, np.append(ids, end), width)
                        record = frame(payload)
                        out.write(record)
                        offsets.append(offset)
                        lengths.append(len(payload))
                        counts.append(len(ids) + 1)
                        offset += len(record)
                    n = len(doc_ids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * n, pa.int32()), pa.array([uri] * n), pa.array(offsets, pa.int64()),
                         pa.array(lengths, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int64())],
                        schema=_INDEX)
        finally:
            if out is not None:
                out.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    index_dir = f"{out_dir.rstrip('/')}/index"
    ordered.mapInArrow(run, INDEX_SCHEMA).write.option("compression", "zstd").parquet(index_dir)
    return docs.sparkSession.read.schema(INDEX_SCHEMA).parquet(index_dir)


def read_records(spark: SparkSession, out_dir: str) -> DataFrame:
    """All records, each file read by one task: ``place`` is the number of ids before it in its file."""
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{out_dir.rstrip('/')}/index")
    files = index.groupBy("part", "file").agg(F.count("*").alias("records"))

    def run(batches):
        for batch in batches:
            for part, uri, records in zip(*(batch.column(c).to_pylist() for c in ("part", "file", "records")), strict=True):
                fs, path = _place(uri)
                place, seen, rows, size = 0, 0, [], 0
                with fs.open_input_stream(path, buffer_size=1 << 20) as f:
                    while (payload := unframe(f)) is not None:
                        doc_id, ids = _ids_of(payload)
                        rows.append((doc_id, part, place, len(ids), ids.tobytes()))
                        place += len(ids)
                        seen, size = seen + 1, size + 4 * len(ids)
                        if size > 4 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                if seen != records:
                    raise ValueError(f"{uri}: {seen} records, the index has {records}")
                if rows:
                    yield _batch(rows)

    return files.repartition(spark.sparkContext.defaultParallelism * 4).mapInArrow(run, RECORD_SCHEMA)


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RECORDS.types, strict=True)],
                                      schema=_RECORDS)


def with_starts(records: DataFrame, index: DataFrame) -> DataFrame:
    """Adds ``start``: all ids before a record, by a prefix sum over the files' totals (one row per file)."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("part").alias("base_part"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return (records.join(F.broadcast(bases), F.col("part") == F.col("base_part"))
            .withColumn("start", F.col("base") + F.col("place")).drop("base", "base_part"))
