"""Readers (CSV, Parquet, catalog table, JDBC query / table), ingest and sinks."""

from .files import read_csv, read_parquet, read_table, sniff_delimiter
from .ingest import ingest_data, load_all_sources, load_source
from .jdbc import read_db_table, read_sql_query
from .sinks import with_dimension_map, write_report

__all__ = ["read_csv", "read_parquet", "read_table", "sniff_delimiter", "ingest_data", "load_all_sources",
           "load_source", "read_db_table", "read_sql_query", "with_dimension_map", "write_report"]
