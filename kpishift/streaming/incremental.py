"""The report kept current over a stream of fact rows (Structured Streaming).

The fused period aggregate is a streaming stateful aggregation: the state
holds one row of running sums per (report key, dimension tuple), so it is
bounded by the report's own output domain, not by the data volume. Each
micro-batch receives the complete aggregate, scores and ranks it with the
batch operators and writes the tables to a folder of its own,
``batch=<id>``; a small table ``current`` then gains a row that names it.
Readers (:func:`published`) take the folder of the highest complete batch,
so they see tables of one batch only, also while the next one is written.
Progress and state live in the checkpoint folder (shared storage), so a
restarted query resumes where it stopped and rewrites an unfinished batch.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..config import InsightConfig
from ..operators.aggregate import aggregate_periods, metric_list
from ..operators.derive import compute_all_derived_metrics
from ..operators.periods import IN_CURRENT, IN_PREVIOUS, flag_periods
from ..functions.dates import DATE_TYPES, as_date
from ..plans.report import report_from_periods
from ..session import scratch_path
from ..sources.sinks import with_dimension_map, write_table


def file_stream(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A file source as a stream. A single file is addressed through a glob
    (the stream source needs a directory as its base path)."""
    if schema is None:
        schema = spark.read.format(fmt).load(path).schema
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        base, name = os.path.split(path)
        return reader.option("basePath", base).load(os.path.join(base, name[:-1] + f"[{name[-1]}]"))
    return reader.load(path)


def streaming_periods(config: InsightConfig, stream: DataFrame) -> DataFrame:
    """Streaming wide aggregate (keys, dims, m_current, m_previous)."""
    rep = config.report
    date_col = rep.primary_date_col
    src = config.dataset.primary
    dtype = stream.schema[date_col].dataType
    if not isinstance(dtype, DATE_TYPES) and not src.date_format:
        raise ValueError("a streamed text date column needs 'date_format' (no whole-column detection on a stream)")
    fact = stream.withColumn(date_col, as_date(stream[date_col], dtype, src.date_format))
    if config.derived_metrics:
        fact = compute_all_derived_metrics(fact, config.derived_metrics)
    flagged = flag_periods(fact, date_col, rep.comparison)
    group = list(rep.report_key) + list(rep.primary_dims)
    return aggregate_periods(flagged, group, metric_list(config), IN_CURRENT, IN_PREVIOUS, rep.accumulator)


def published(spark: SparkSession, sink_path: str, name: str) -> DataFrame:
    """A table (insights, summary, totals) of the latest complete batch."""
    root = sink_path.rstrip("/")
    latest = spark.read.parquet(f"{root}/current").agg({"id": "max"}).first()[0]
    return spark.read.parquet(f"{root}/batch={latest}/{name}")


def stream_report(config: InsightConfig, stream: DataFrame, sink_path: str, checkpoint_location: str | None = None,
                  available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Start the query; every micro-batch republishes insights, summary and totals.

    ``available_now`` processes what is there and stops (scheduled runs);
    otherwise ``processing_time`` (e.g. ``"1 minute"``) keeps it running.
    """
    spark = stream.sparkSession
    ckpt = checkpoint_location or scratch_path(spark, f"stream-{os.path.basename(sink_path.rstrip('/'))}")
    periods = streaming_periods(config, stream)

    root = sink_path.rstrip("/")

    def publish(batch: DataFrame, epoch_id: int) -> None:
        batch.persist()
        try:
            tables = report_from_periods(config, batch)
            for name, df in (("insights", with_dimension_map(tables.insights, tables.dims)),
                             ("summary", tables.summary), ("totals", tables.totals)):
                write_table(df, f"{root}/batch={epoch_id}/{name}", partition_by=list(tables.keys) or None,
                            bounded=bool(tables.top_n))
            spark.range(epoch_id, epoch_id + 1).coalesce(1).write.mode("append").parquet(f"{root}/current")
        finally:
            batch.unpersist()

    writer = (periods.writeStream.outputMode("complete").foreachBatch(publish)
              .option("checkpointLocation", ckpt))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
