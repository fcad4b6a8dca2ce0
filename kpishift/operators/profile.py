"""Column roles (date / dimension / metric) from a one-pass profile, and suggested periods."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import DATE_PATTERNS, DATE_TYPES, parse_with
from ..functions.numeric import col
from .periods import parse_date_column

# Name hints for each role.
DATE_NAME_HINTS = ("date", "dt_", "timestamp", "created_at")
ID_NAME_PATTERN = re.compile(r"(^id$|_id$|id$|key$|_key$|code$|^year$|_year$|^year_)", re.IGNORECASE)
# Suggested periods, in days back from the anchor day.
CURRENT_DAYS = 7          # current = [anchor - 7, anchor]
PREVIOUS_START_DAYS = 14  # previous = [anchor - 14, anchor - 8]
PREVIOUS_END_DAYS = 8

# An integer column is a category if it has at most this many
# distinct values and they make up at most this share of its rows ...
MAX_CATEGORIES = 24
MAX_CATEGORY_SHARE = 0.05
# ... unless its name says that it counts or measures.
MEASURE_NAME_PATTERN = re.compile(r"(amount|count|total|price|revenue|sales|income|cost|qty|quantity|balance|value|size|score)",
                                  re.IGNORECASE)

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def date_counts(c, dtype: T.DataType) -> list:
    """How many values are dates: per format for text, else one count."""
    if isinstance(dtype, DATE_TYPES):
        return [F.count(c)]
    if isinstance(dtype, T.StringType):
        return [F.count(parse_with(c, p)) for p in (*DATE_PATTERNS, None)]
    return [F.lit(0)]


def column_flags(fields: list) -> dict[str, list[bool]]:
    """What the role rules ask of a column's type and name, per flag in the order of ``fields``."""
    kinds = [f.dataType for f in fields]
    return {
        "__kpi_temporal": [isinstance(t, DATE_TYPES) for t in kinds],
        "__kpi_string": [isinstance(t, T.StringType) for t in kinds],
        "__kpi_text": [isinstance(t, (T.StringType, T.BooleanType)) for t in kinds],
        "__kpi_numeric": [isinstance(t, NUMERIC) for t in kinds],
        "__kpi_integral": [isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for t in kinds],
        "__kpi_date_name": [any(h in f.name.lower() for h in DATE_NAME_HINTS) for f in fields],
        "__kpi_id_name": [bool(ID_NAME_PATTERN.search(f.name)) for f in fields],
        "__kpi_measure_name": [bool(MEASURE_NAME_PATTERN.search(f.name)) for f in fields],
    }


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, counts, date-like count, distinct estimate, role.

    All statistics come from a single aggregate over the data (every column
    is read once, partial aggregation on each partition). Role rules:
    * date: the first column that is date/timestamp typed, or text whose
      non-null values are all parsed by one and the same format, or text named like a
      date (``date``, ``dt_``, ``timestamp``, ``created_at``) without any
      value; later such columns become dimensions. Text that mixes
      formats is never a date: no report could read it;
    * dimension: text or boolean, an integer named like an id, key, code or
      year, or a low-cardinality integer: an estimated number of distinct values
      of at most ``MAX_CATEGORIES`` and ``MAX_CATEGORY_SHARE`` of its non-null
      rows, unless its name is one of a measure;
    * metric: any other number;
    * none: other types.
    ``date_like_count`` is the count of the format that parses most values.
    ``distinct_estimate`` is HyperLogLog++ (relative standard deviation 5 %;
    exact in practice at the size of the category rule). ``null_rate`` is the
    share of null rows, 0 without rows.
    """
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(fields):
        c = col(f.name)
        aggs.append(F.count(c).alias(f"n{i}"))
        counts = date_counts(c, f.dataType)
        aggs.append((F.greatest(*counts) if len(counts) > 1 else counts[0]).alias(f"d{i}"))
        aggs.append(F.approx_count_distinct(c).alias(f"u{i}"))
    stats = df.agg(*aggs)
    args = [F.lit(len(fields))]
    flags = column_flags(fields)
    for i, f in enumerate(fields):
        args += [F.lit(f.name), F.lit(i), F.lit(f.dataType.simpleString()), F.col(f"n{i}").cast("long"), F.col(f"d{i}").cast("long"),
                 F.col(f"u{i}").cast("long"), *[F.lit(flag[i]) for flag in flags.values()]]
    long = stats.select(
        F.col("__rows").alias("row_count"),
        F.stack(*args).alias("column_name", "ordinal", "data_type", "non_null_count", "date_like_count",
                             "distinct_estimate", *flags))
    return with_roles(long)


def with_roles(long: DataFrame, extra: dict | None = None) -> DataFrame:
    """Profile rows with their role (and ``extra`` columns by name), from one row per column with its counts and ``__kpi_`` flags (see :func:`column_flags`)."""
    candidate = (F.col("__kpi_temporal")
                 | (F.col("__kpi_string") & (F.col("date_like_count") == F.col("non_null_count"))
                    & ((F.col("non_null_count") > 0) | F.col("__kpi_date_name"))))
    first_date = F.min(F.when(candidate, F.col("ordinal"))).over(Window.partitionBy())
    few = (F.col("__kpi_integral") & ~F.col("__kpi_measure_name") & (F.col("distinct_estimate") <= MAX_CATEGORIES)
           & (F.col("distinct_estimate") <= MAX_CATEGORY_SHARE * F.col("non_null_count")))
    role = (F.when(candidate & (F.col("ordinal") == first_date), F.lit("date"))
            .when(candidate | F.col("__kpi_text"), F.lit("dimension"))
            .when((F.col("__kpi_integral") & F.col("__kpi_id_name")) | few, F.lit("dimension"))
            .when(F.col("__kpi_numeric"), F.lit("metric"))
            .otherwise(F.lit("none")))
    return long.select(
        "column_name", "ordinal", "data_type", "row_count", "non_null_count",
        (F.col("row_count") - F.col("non_null_count")).alias("null_count"),
        F.when(F.col("row_count") > 0, (F.col("row_count") - F.col("non_null_count")) / F.col("row_count"))
        .otherwise(0.0).alias("null_rate"),
        "date_like_count", "distinct_estimate", role.alias("role"), *[c.alias(n) for n, c in (extra or {}).items()],
    )


def suggested_ranges(df: DataFrame, date_col: str) -> DataFrame:
    """Current = last 7 days up to the anchor, previous = the 7 days before that.

    Anchor = latest date in ``df[date_col]`` (one aggregate; a text column is
    read with one format that fits all its values, as everywhere else). Bounds
    as ``YYYY-MM-DD`` strings, ready for a config.
    """
    base = parse_date_column(df.select(col(date_col)), date_col).agg(F.max(col(date_col)).alias("anchor"))
    a = F.col("anchor")

    def fmt(d):
        return F.date_format(d, "yyyy-MM-dd")

    return base.select(
        fmt(a).alias("anchor"),
        fmt(F.date_sub(a, CURRENT_DAYS)).alias("current_start"),
        fmt(a).alias("current_end"),
        fmt(F.date_sub(a, PREVIOUS_START_DAYS)).alias("previous_start"),
        fmt(F.date_sub(a, PREVIOUS_END_DAYS)).alias("previous_end"),
    )


def suggested_ranges_today(spark) -> DataFrame:
    """Same periods anchored on today's date (no data needed)."""
    return spark.range(1).select(F.current_date().alias("anchor")).select(
        F.date_format("anchor", "yyyy-MM-dd").alias("anchor"),
        F.date_format(F.date_sub("anchor", CURRENT_DAYS), "yyyy-MM-dd").alias("current_start"),
        F.date_format("anchor", "yyyy-MM-dd").alias("current_end"),
        F.date_format(F.date_sub("anchor", PREVIOUS_START_DAYS), "yyyy-MM-dd").alias("previous_start"),
        F.date_format(F.date_sub("anchor", PREVIOUS_END_DAYS), "yyyy-MM-dd").alias("previous_end"),
    )
