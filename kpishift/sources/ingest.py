"""Load every configured source and join them into one fact table."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..config import InsightConfig, SourceConfig
from ..operators.joins import join_sources
from ..operators.periods import parse_date_column
from .csv_folder import read_csv_folder
from .files import read_csv, read_parquet, read_table, resolve_path
from .jdbc import read_db_table, read_sql_query

log = logging.getLogger(__name__)



def _csv(spark: SparkSession, cfg: SourceConfig, base: str) -> DataFrame:
    path = resolve_path(cfg.path, base)
    if cfg.own_headers:
        return read_csv_folder(spark, path, cfg.schema).rows
    return read_csv(spark, path, cfg.sep, cfg.schema, cfg.options)


READERS = {
    "csv": _csv,
    "parquet": lambda spark, cfg, base: read_parquet(spark, resolve_path(cfg.path, base), cfg.options),
    "table": lambda spark, cfg, base: read_table(spark, cfg.table),
    "sql": lambda spark, cfg, base: read_sql_query(spark, cfg),
    "database": lambda spark, cfg, base: read_db_table(spark, cfg),
}


def load_source(spark: SparkSession, name: str, cfg: SourceConfig, base_path: str = "") -> DataFrame:
    reader = READERS.get(cfg.type)
    if reader is None:
        raise ValueError(f"source {name!r}: there is no reader for type {cfg.type!r}")
    return reader(spark, cfg, base_path)


def load_all_sources(spark: SparkSession, config: InsightConfig, base_path: str = "",
                     frames: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Lazy DataFrames by source name; ``frames`` overrides loading per name."""
    frames = frames or {}
    return {name: frames[name] if name in frames else load_source(spark, name, cfg, base_path)
            for name, cfg in config.dataset.sources.items()}


def date_fallback(columns: list[str], date_col: str) -> str:
    """The configured date column, else the first column named like a date."""
    if date_col in columns:
        return date_col
    candidates = [c for c in columns if "date" in c.lower() or "dt_" in c.lower()]
    if not candidates:
        raise ValueError(f"no column is named {date_col!r} or like a date")
    log.warning("date column %r not found; using %r", date_col, candidates[0])
    return candidates[0]


def normalise_dates(frames: dict[str, DataFrame], config: InsightConfig) -> dict[str, DataFrame]:
    """Each source's own date column to DATE before joining, so a text key and a
    date key compare as dates."""
    out = {}
    for name, df in frames.items():
        cfg = config.dataset.sources[name]
        if cfg.date_col in df.columns:
            df = parse_date_column(df, cfg.date_col, pattern=cfg.date_format)
        out[name] = df
    return out


def ingest_data(spark: SparkSession, config: InsightConfig, base_path: str = "",
                frames: dict[str, DataFrame] | None = None) -> tuple[DataFrame, str]:
    """(joined fact table, date column to use). Nothing runs yet except the
    small jobs that sniff a CSV delimiter or detect a text date format."""
    return join_loaded(normalise_dates(load_all_sources(spark, config, base_path, frames), config), config)


def join_loaded(loaded: dict[str, DataFrame], config: InsightConfig) -> tuple[DataFrame, str]:
    """:func:`ingest_data` for sources that are loaded, their dates normalised."""
    fact = join_sources(loaded, config)
    primary_date = date_fallback(fact.columns, config.dataset.primary.date_col)
    report_date = config.report.primary_date_col
    if report_date not in fact.columns:
        report_date = primary_date if report_date == config.dataset.primary.date_col else date_fallback(
            fact.columns, report_date)
    if not isinstance(fact.schema[report_date].dataType, T.DateType):
        # a fallback column, or a report date other than the sources' own
        fact = parse_date_column(fact, report_date)
    return fact, report_date
