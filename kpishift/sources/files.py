"""File and catalog sources: CSV (delimiter sniffed), Parquet, catalog tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def resolve_path(path: str, base_path: str = "") -> str:
    """Relative paths are taken from ``base_path`` (URIs with a scheme are kept)."""
    if base_path and "://" not in path and not Path(path).is_absolute():
        return str(Path(base_path) / path)
    return path


def sniff_delimiter(first_line: str) -> str:
    """``;`` or tab when strictly the most frequent in the header line, else ``,``."""
    semi, comma, tab = first_line.count(";"), first_line.count(","), first_line.count("\t")
    if semi > comma and semi > tab:
        return ";"
    if tab > comma and tab > semi:
        return "\t"
    return ","


def _missing(exc: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in (getattr(exc, "getErrorClass", lambda: "")() or "") or "Path does not exist" in str(exc)


def read_csv(spark: SparkSession, path: str, sep: str | None = None, schema: str | None = None,
             options: dict | None = None) -> DataFrame:
    """Header row, UTF-8; the delimiter comes from the first line unless given.

    Sniffing reads one line (a one-row job). Without ``schema`` Spark
    infers types, which costs one extra pass over the data; give a DDL
    schema for large inputs.
    """
    try:
        if sep is None:
            head = spark.read.text(path).first()
            sep = sniff_delimiter(head[0] if head else "")
        reader = spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8")
        reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
        for k, v in (options or {}).items():
            reader = reader.option(k, v)
        return reader.csv(path)
    except AnalysisException as exc:
        if _missing(exc):
            raise FileNotFoundError(f"there is no CSV file at {path}") from exc
        raise


def read_parquet(spark: SparkSession, path: str, options: dict | None = None) -> DataFrame:
    try:
        return spark.read.options(**(options or {})).parquet(path)
    except AnalysisException as exc:
        if _missing(exc):
            raise FileNotFoundError(f"there is nothing at {path}") from exc
        raise


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
