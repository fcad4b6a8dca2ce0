"""Database sources through Spark's JDBC reader (query or table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import ConnectionConfig, SourceConfig, connection_string_options


def _partition_options(cfg: SourceConfig) -> dict[str, str]:
    """Parallel read: ``num_partitions`` range queries on ``partition_column``.

    Without these a JDBC read is one task; for large tables give a numeric,
    date or timestamp column with its bounds.
    """
    if not cfg.partition_column:
        return {}
    if cfg.lower_bound is None or cfg.upper_bound is None or not cfg.num_partitions:
        raise ValueError("partition_column needs lower_bound, upper_bound and num_partitions")
    return {
        "partitionColumn": cfg.partition_column,
        "lowerBound": str(cfg.lower_bound),
        "upperBound": str(cfg.upper_bound),
        "numPartitions": str(int(cfg.num_partitions)),
    }


def sql_source_options(cfg: SourceConfig) -> dict[str, str]:
    opts = connection_string_options(cfg.connection_string)
    if cfg.partition_column:
        # Spark's partitioned read needs ``dbtable``; wrap the query as a subquery.
        opts["dbtable"] = f"({cfg.query}) q"
        opts.update(_partition_options(cfg))
    else:
        opts["query"] = cfg.query
    opts.update({k: str(v) for k, v in cfg.options.items()})
    return opts


def table_source_options(cfg: SourceConfig) -> dict[str, str]:
    conn: ConnectionConfig = cfg.connection
    opts = conn.jdbc_options()
    opts["dbtable"] = cfg.table
    opts.update(_partition_options(cfg))
    opts.update({k: str(v) for k, v in cfg.options.items()})
    return opts


def read_sql_query(spark: SparkSession, cfg: SourceConfig) -> DataFrame:
    """Run the user's query on the database (``type: sql``)."""
    return spark.read.format("jdbc").options(**sql_source_options(cfg)).load()


def read_db_table(spark: SparkSession, cfg: SourceConfig) -> DataFrame:
    """Read a table (``type: database``) keeping only dims, metrics, date and keys.

    The ``select`` is pruned into the remote SELECT list by the JDBC scan,
    and period filters on the date column are pushed into its WHERE clause.
    """
    df = spark.read.format("jdbc").options(**table_source_options(cfg)).load()
    cols = cfg.scan_columns()
    return df.select(*[c for c in cols if c in df.columns]) if cols else df
