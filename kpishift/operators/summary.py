"""Report-level tables over the ranked insights: summary, totals, breakdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import col, qi, round_sql
from ..functions.text import value_str_sql

RECORD_FIELDS = ["rank", "metric", "current_value", "previous_value", "delta", "delta_pct", "impact_score",
                 "direction"]

# How many rows the breakdown reads and keeps, and the totals kept.
BREAKDOWN_ROWS = 10
BREAKDOWN_ROWS_NO_DIMS = 6
BREAKDOWN_KEEP = 6
TOTALS_KEEP = 6


def _record(dims: list[str]):
    return F.struct(*[col(c) for c in ["rank", *dims, *RECORD_FIELDS[1:]]])


def insight_summary(ranked: DataFrame, dims: list[str], keys: list[str] = ()) -> DataFrame:
    """Counts, top mover, biggest gain and biggest drop over the ranked rows.

    top mover = rank 1; biggest gain = largest delta % among ``up`` rows,
    biggest drop = smallest among ``down`` rows, the better rank winning
    ties. Without keys this is one row even for no insights (counts 0,
    records null). Works on at most top-N rows per key.
    """
    rec = _record(list(dims))
    up = F.col("direction") == "up"
    down = F.col("direction") == "down"
    aggs = [
        F.count(F.lit(1)).alias("total_insights"),
        F.count_if(up).alias("total_gains"),
        F.count_if(down).alias("total_drops"),
        F.min_by(rec, F.col("rank")).alias("top_mover"),
        F.max_by(rec, F.when(up, F.struct(F.col("delta_pct"), -F.col("rank")))).alias("biggest_gain"),
        F.min_by(rec, F.when(down, F.struct(F.col("delta_pct"), F.col("rank")))).alias("biggest_drop"),
    ]
    keys = list(keys)
    return ranked.groupBy(*[col(k) for k in keys]).agg(*aggs) if keys else ranked.agg(*aggs)


def period_totals(periods: DataFrame, metrics: list[str], keys: list[str] = (), keep: int = TOTALS_KEEP) -> DataFrame:
    """Per metric: total of each period; the ``keep`` largest by current + previous.

    Reads the (small) period aggregate, not the facts. Totals are rounded to
    4 decimals like insight values; ties: metric name.
    """
    keys = list(keys)
    present = [m for m in metrics if f"{m}_current" in periods.columns and f"{m}_previous" in periods.columns]
    if not present:
        return periods.select(*[col(k) for k in keys], F.lit(None).cast("string").alias("metric"),
                              F.lit(None).cast("double").alias("current_total"),
                              F.lit(None).cast("double").alias("previous_total"),
                              F.lit(None).cast("int").alias("position")).where(F.lit(False))
    sums = []
    for m in present:
        for s in ("current", "previous"):
            sums.append(F.coalesce(F.sum(col(f"{m}_{s}").cast("double")), F.lit(0.0)).alias(f"{m}_{s}"))
    wide = periods.groupBy(*[col(k) for k in keys]).agg(*sums) if keys else periods.agg(*sums)
    args = [F.lit(len(present))]
    for m in present:
        args += [F.lit(m), col(f"{m}_current"), col(f"{m}_previous")]
    long = wide.select(*[col(k) for k in keys], F.stack(*args).alias("metric", "__kpi_cur", "__kpi_prev")).select(
        *[col(k) for k in keys], "metric", F.expr(round_sql("__kpi_cur", 4)).alias("current_total"),
        F.expr(round_sql("__kpi_prev", 4)).alias("previous_total"))
    order = [(F.col("current_total") + F.col("previous_total")).desc(), F.col("metric").asc()]
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*order) if keys else Window.orderBy(*order)
    return long.withColumn("position", F.row_number().over(w)).where(F.col("position") <= keep)


def dimension_breakdown(ranked: DataFrame, dims: list[str], keys: list[str] = (),
                        dim_types: dict | None = None) -> DataFrame:
    """Share by value of the first dimension over the first 10 insights.

    Label = first dimension's value, value = sum of |current_value| (all
    KPIs mixed). Without dimensions: label = metric over the first 6,
    value = |impact| of its last (worst-ranked) row. Keeps the 6 largest;
    ties keep first-appearance order.
    """
    keys = list(keys)
    dims = list(dims)
    if dims:
        d0 = dims[0]
        src = ranked.where(F.col("rank") <= BREAKDOWN_ROWS)
        label = F.expr(value_str_sql(qi(d0), (dim_types or {}).get(d0)))
        grouped = src.groupBy(*[col(k) for k in keys], label.alias("label")).agg(
            F.sum(F.abs(F.col("current_value"))).alias("value"), F.min("rank").alias("__kpi_first"))
    else:
        src = ranked.where(F.col("rank") <= BREAKDOWN_ROWS_NO_DIMS)
        grouped = src.groupBy(*[col(k) for k in keys], F.col("metric").alias("label")).agg(
            F.max_by(F.abs(F.col("impact_score")), F.col("rank")).alias("value"), F.min("rank").alias("__kpi_first"))
    grouped = grouped.withColumn("value", F.expr(round_sql("value", 4)))
    order = [F.col("value").desc(), F.col("__kpi_first").asc()]
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*order) if keys else Window.orderBy(*order)
    return (grouped.withColumn("position", F.row_number().over(w))
            .where(F.col("position") <= BREAKDOWN_KEEP).drop("__kpi_first"))
