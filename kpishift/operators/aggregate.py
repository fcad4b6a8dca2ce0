"""SUM by dimensions: per period (literal) or both periods in one pass (fused)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import InsightConfig
from ..functions.numeric import col, qi
from .exact import exact_period_sums
from .periods import IN_CURRENT, IN_PREVIOUS

# Exact accumulator for floating metrics: sums become order-independent. Every
# value is rounded to 10 decimals, and must be below DECIMAL_LIMIT.
DECIMAL_ACCUMULATOR = T.DecimalType(38, 10)
DECIMAL_LIMIT = 1e27


def metric_list(config: InsightConfig) -> list[str]:
    """Primary metrics, then derived names, then KPIs not yet listed (no repeats)."""
    out: list[str] = []
    for m in [*config.dataset.primary.metrics, *config.derived_metrics.keys(), *config.report.kpi_priority]:
        if m not in out:
            out.append(m)
    return out


def _floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def decimal_sum_sql(value: str) -> str:
    """Exact sum of a double expression, as a double.

    Numbers are added as decimals; NaN and infinities, if there are any, decide
    the sum as they do in a sum of doubles. A number or a total out of range
    fails the query with a message, whatever the session's ANSI setting.
    """
    odd = f"(isnan({value}) OR abs({value}) = double('infinity'))"
    number = (f"CASE WHEN {odd} THEN NULL WHEN abs({value}) >= {DECIMAL_LIMIT!r}D THEN CAST(raise_error("
              f"'accumulator decimal holds values below 1e27 only; use accumulator double') AS {DECIMAL_ACCUMULATOR.simpleString()}) "
              f"ELSE CAST({value} AS {DECIMAL_ACCUMULATOR.simpleString()}) END")
    total = f"try_sum({number})"
    return (f"coalesce(sum(CASE WHEN {odd} THEN {value} END), "
            f"CASE WHEN count({number}) > 0 AND {total} IS NULL THEN CAST(raise_error("
            f"'the total is out of range for accumulator decimal; use accumulator double') AS DOUBLE) "
            f"ELSE CAST({total} AS DOUBLE) END)")


def sum_sql(value: str, dtype: T.DataType, accumulator: str = "double") -> str:
    """SUM keeping the native type; ``decimal`` sums floats exactly, then back to double."""
    if accumulator == "decimal" and _floating(dtype):
        return decimal_sum_sql(f"CAST({value} AS DOUBLE)")
    return f"sum({value})"


def zero_if_null(c: Column) -> Column:
    """Sum over no rows (or only nulls) counts as 0."""
    return F.coalesce(c, F.lit(0))


def _valid_metrics(df: DataFrame, dims: list[str], metrics: list[str]) -> list[str]:
    if dims:
        missing = [d for d in dims if d not in df.columns]
        if missing:
            raise ValueError(f"these dimensions are no columns of the data: {', '.join(missing)}")
    valid = [m for m in metrics if m in df.columns and m not in dims]  # absent metrics are skipped
    if dims and not valid:
        raise ValueError(f"none of the metrics {list(metrics)} is a column besides the dimensions")
    return valid


def _exact(df: DataFrame, dims: list[str], metrics: list[str], types: dict, in_current: str, in_previous: str) -> DataFrame:
    """Period sums with exact doubles; the other metrics keep the type of their plain sum."""
    floats = [m for m in metrics if _floating(types[m])]
    others = {f"{m}_{suffix}": f"CASE WHEN {flag} THEN {qi(m)} END" for m in metrics if m not in floats
              for flag, suffix in ((in_current, "current"), (in_previous, "previous"))}
    sums = exact_period_sums(df, dims, floats, others, in_current, in_previous)
    columns = [col(d) for d in dims]
    for m in metrics:
        for suffix in ("current", "previous"):
            c = col(f"{m}_{suffix}")
            if isinstance(types[m], T.DecimalType):
                c = c.cast(T.DecimalType(min(38, types[m].precision + 10), types[m].scale))
            columns.append(c.alias(f"{m}_{suffix}"))
    return sums.select(*columns)


def aggregate_by_dimensions(df: DataFrame, dims: list[str], metrics: list[str],
                            accumulator: str = "double") -> DataFrame:
    """SUM of each metric per dimension tuple; one global row without dims."""
    dims = list(dims)
    valid = _valid_metrics(df, dims, metrics)
    types = {f.name: f.dataType for f in df.schema.fields}
    if accumulator == "exact" and any(_floating(types[m]) for m in valid):
        sums = _exact(df, dims, valid, types, "true", "false")
        return sums.select(*[col(d) for d in dims], *[col(f"{m}_current").alias(m) for m in valid])
    aggs = [zero_if_null(F.expr(sum_sql(qi(m), types[m], accumulator))).alias(m) for m in valid]
    if not dims:
        return df.agg(*aggs) if aggs else df.agg(F.count(F.lit(1)).alias("__rows")).drop("__rows")
    return df.groupBy(*[col(d) for d in dims]).agg(*aggs)


def aggregate_periods(df: DataFrame, dims: list[str], metrics: list[str], in_current: str = IN_CURRENT,
                      in_previous: str = IN_PREVIOUS, accumulator: str = "double") -> DataFrame:
    """Both periods in one hash aggregate: ``m_current`` and ``m_previous`` per group.

    ``in_current`` / ``in_previous`` are boolean SQL expressions (usually the
    flag columns). ``df`` should already be restricted to rows of either period (the
    predicate reaches the scan). A row in both periods (overlap) counts in
    both sums; a group seen in one period only gets 0 for the other, which
    is what a full outer join of two per-period aggregates gives, in one
    scan and one exchange instead of two scans, two exchanges and a join.
    """
    dims = list(dims)
    valid = _valid_metrics(df, dims, metrics)
    types = {f.name: f.dataType for f in df.schema.fields}
    if accumulator == "exact" and any(_floating(types[m]) for m in valid):
        return _exact(df, dims, valid, types, in_current, in_previous)
    aggs = []
    for m in valid:
        for flag, suffix in ((in_current, "current"), (in_previous, "previous")):
            picked = f"CASE WHEN {flag} THEN {qi(m)} END"
            total = sum_sql(picked, types[m], accumulator)
            aggs.append(F.expr(f"coalesce({total}, 0) AS {qi(m + '_' + suffix)}"))
    if not dims:
        return df.agg(*aggs) if aggs else df.agg(F.count(F.lit(1)).alias("__rows")).drop("__rows")
    return df.groupBy(*[col(d) for d in dims]).agg(*aggs)
