"""Date normalisation and the two comparison periods."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ComparisonConfig
from ..functions.numeric import qi
from ..functions.dates import DATE_PATTERNS, DATE_TYPES, as_date, parse_with

IN_CURRENT = "__kpi_in_current"  # reserved: never a column of a source
IN_PREVIOUS = "__kpi_in_previous"


def detect_date_pattern(df: DataFrame, col: str) -> str | None:
    """First pattern that parses *every* non-null value of ``col``, found now (to be put into a config, say).

    One aggregate job counts failures for all candidates at once; the format
    is chosen for the whole column, never per row (that would mix month-first
    and day-first). ``None`` means the ISO cast fallback parses everything.
    Raises ``ValueError`` when nothing fits.
    """
    c = F.col(qi(col)).cast("string")
    candidates = list(DATE_PATTERNS) + [None]
    aggs = [F.count_if(c.isNotNull() & parse_with(c, p).isNull()).alias(f"f{i}") for i, p in enumerate(candidates)]
    row = df.agg(*aggs).first()
    for i, pattern in enumerate(candidates):
        if row[f"f{i}"] == 0:
            return pattern
    raise ValueError(f"no known date format fits every value of column {col!r}")


def format_mask(value: Column) -> Column:
    """One bit per candidate format that parses the text ``value`` (null for a null): bit i is pattern i, the last the ISO cast."""
    bits = [F.when(parse_with(value, p).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0))
            for i, p in enumerate([*DATE_PATTERNS, None])]
    return F.when(value.isNotNull(), sum(bits[1:], bits[0]))


def detected_mask(df: DataFrame, col: str) -> Column:
    """The formats that parse every non-null value of ``col``, as a scalar subquery (every format for no values)."""
    mask = F.bit_and(format_mask(F.col(qi(col)).cast("string")))
    return df.agg(F.coalesce(mask, F.lit((1 << len(DATE_PATTERNS) + 1) - 1)).alias("mask")).scalar()


def parse_detected(df: DataFrame, col: str) -> Column:
    """``col`` parsed with the first format that fits the whole column, all within one lazy plan.

    The format is found by the subquery of :func:`detected_mask` when the plan
    runs; if none fits, the plan fails with a message.
    """
    mask, value = detected_mask(df, col), F.col(qi(col)).cast("string")
    out = F.when(mask == 0, F.raise_error(F.lit(f"no known date format fits every value of column {col!r}")).cast("date"))
    for i, pattern in enumerate([*DATE_PATTERNS, None]):
        out = out.when(mask.bitwiseAND(1 << i) != 0, parse_with(value, pattern))
    return out


def parse_date_column(df: DataFrame, col: str, pattern: str | None = None, detect: bool = True) -> DataFrame:
    """Date kept, timestamp -> date, string parsed with one whole-column format.

    No job runs here: an undetected format is part of the plan (:func:`parse_detected`).
    """
    if col not in df.columns:
        raise ValueError(f"there is no column {col!r} to take dates from")
    dtype = df.schema[col].dataType
    if isinstance(dtype, DATE_TYPES):
        if isinstance(dtype, T.DateType):
            return df
        return df.withColumn(col, F.to_date(F.col(qi(col))))
    if not isinstance(dtype, T.StringType):
        raise ValueError(f"column {col!r} is {dtype.simpleString()}, not a date, timestamp or text")
    if pattern is None and detect:
        return df.withColumn(col, parse_detected(df, col))
    return df.withColumn(col, as_date(F.col(qi(col)), dtype, pattern))


def period_predicates(date_col: Column, comparison: ComparisonConfig) -> tuple[Column, Column]:
    """Inclusive ranges; null dates are in neither period."""
    cs, ce, ps, pe = comparison.bounds()
    return _between(date_col, cs, ce), _between(date_col, ps, pe)


def _between(c: Column, lo: date, hi: date) -> Column:
    return (c >= F.lit(lo)) & (c <= F.lit(hi))


def split_by_period(df: DataFrame, date_col: str, comparison: ComparisonConfig) -> tuple[DataFrame, DataFrame]:
    """(current rows, previous rows); overlapping periods put a row in both."""
    in_cur, in_prev = period_predicates(F.col(qi(date_col)), comparison)
    return df.where(in_cur), df.where(in_prev)


def period_predicates_sql(date_col: str, comparison: ComparisonConfig) -> tuple[str, str]:
    cs, ce, ps, pe = comparison.bounds()
    c = qi(date_col)
    return (f"({c} >= DATE'{cs.isoformat()}' AND {c} <= DATE'{ce.isoformat()}')",
            f"({c} >= DATE'{ps.isoformat()}' AND {c} <= DATE'{pe.isoformat()}')")


def flag_periods(df: DataFrame, date_col: str, comparison: ComparisonConfig) -> DataFrame:
    """Rows of either period with two boolean flags (one pass instead of two).

    The OR of both ranges reaches the Parquet scan as a pushed filter.
    """
    in_cur, in_prev = period_predicates_sql(date_col, comparison)
    return df.where(f"{in_cur} OR {in_prev}").selectExpr(
        "*", f"{in_cur} AS {IN_CURRENT}", f"{in_prev} AS {IN_PREVIOUS}")
