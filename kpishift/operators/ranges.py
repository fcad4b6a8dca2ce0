"""Many comparison ranges from one pass over the facts: daily sums, running totals, differences.

The facts are added up once per group and day (:func:`daily_sums`, one shuffle
of partial sums). Per group, totals run over its days; the sum of any range is
the total at its last day less the total before its first, so a range costs
four look-ups a group, however many facts it spans. A day's total holds until
the group's next day; it is laid out over these days and met with the days
that ranges begin or end at. Windows and sums follow the groups' own
partitioning: after the daily sums nothing but the daily rows is shuffled, and
a group has at most one row a day.

Floating metrics are added up as decimals of ``DECIMAL_ACCUMULATOR`` (each value
rounded to 10 decimals), so that a difference of two totals is exact; counts
of NaN and infinities run beside them and decide a range's sum as they do in a
sum of doubles. Values of 1e27 and more fail the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import col, qi
from .aggregate import DECIMAL_ACCUMULATOR, DECIMAL_LIMIT

DAY, ROWS = "__kpi_day", "__kpi_rows"  # reserved names of the kept daily sums
BOUNDS = ("current_start", "current_end", "previous_start", "previous_end")
#: Up to so many ranges (four short rows each) are broadcast; more are joined by a shuffle.
BROADCAST_RANGES = 100_000

_KINDS = {"nan": "isnan({v})", "up": "{v} = double('infinity')", "down": "{v} = -double('infinity')"}


def sum_columns(metrics: list[str]) -> list[str]:
    """Columns that hold a metric's mergeable sums."""
    return [c for m in metrics for c in (m, *(f"{m}__kpi_{k}" for k in _KINDS))]


def daily_sums(facts: DataFrame, date_col: str, dims: list[str], metrics: list[str], more_keys: tuple = ()) -> DataFrame:
    """dims, ``__kpi_day``, ``__kpi_rows`` and each metric's sums (see :func:`sum_columns`) of rows with a date.

    Rows of the same group and day may be added up further, in any order (:func:`merge_daily`).
    """
    aggs = [F.count(F.lit(1)).alias(ROWS)]
    for m in metrics:
        dtype = facts.schema[m].dataType
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            v = f"CAST({qi(m)} AS DOUBLE)"
            odd = f"(isnan({v}) OR abs({v}) = double('infinity'))"
            number = (f"CASE WHEN {odd} THEN NULL WHEN abs({v}) >= {DECIMAL_LIMIT!r}D THEN CAST(raise_error("
                      f"'daily sums hold values below 1e27 only') AS {DECIMAL_ACCUMULATOR.simpleString()}) "
                      f"ELSE CAST({v} AS {DECIMAL_ACCUMULATOR.simpleString()}) END")
            kinds = {k: f"count_if({c.format(v=v)})" for k, c in _KINDS.items()}
        else:
            number, kinds = f"CAST({qi(m)} AS {DECIMAL_ACCUMULATOR.simpleString()})", dict.fromkeys(_KINDS, "0L")
        aggs.append(F.expr(f"coalesce(sum({number}), 0)").cast(DECIMAL_ACCUMULATOR).alias(m))
        aggs += [(F.expr(x) if x != "0L" else F.max(F.lit(0).cast("long"))).alias(f"{m}__kpi_{k}") for k, x in kinds.items()]
    by = [col(k) for k in (*more_keys, *dims)]
    return facts.where(col(date_col).isNotNull()).groupBy(*by, col(date_col).cast("date").alias(DAY)).agg(*aggs)


def merge_daily(daily: DataFrame, dims: list[str], metrics: list[str]) -> DataFrame:
    """Daily sums of the same group and day added up."""
    aggs = [F.sum(ROWS).alias(ROWS)] + [F.sum(col(c)).cast(daily.schema[c].dataType).alias(c) for c in sum_columns(metrics)]
    return daily.groupBy(*[col(d) for d in dims], DAY).agg(*aggs)


def _range_days(ranges: DataFrame, key: str) -> DataFrame:
    """Each range's four signed days: the totals whose sum is the range's."""
    def entry(bound, sign, period):
        day = F.col(bound).cast("date") if sign > 0 else F.date_sub(F.col(bound).cast("date"), 1)
        return F.struct(day.alias("at"), *[F.lit(sign if p == period else 0).cast("long").alias(f"__kpi_{p}") for p in ("current", "previous")])

    days = [entry(f"{p}_{b}", s, p) for p in ("current", "previous") for b, s in (("end", 1), ("start", -1))]
    return ranges.where(" AND ".join(f"{b} IS NOT NULL" for b in BOUNDS)).select(
        col(key), F.explode(F.array(*days)).alias("x")).select(col(key), "x.*")


def range_sums(daily: DataFrame, dims: list[str], metrics: dict[str, T.DataType], ranges: DataFrame, key: str = "range_id",
               few: bool = False) -> DataFrame:
    """``key``, dims, ``m_current``, ``m_previous`` for every range and every group with a row in one of its periods.

    ``metrics`` maps names to the types of the sums; ``ranges`` has ``key`` and the four
    bounds (inclusive; a period that ends before it begins is empty; a range with a null bound gives no rows).
    ``few``: there are at most ``BROADCAST_RANGES`` of them.
    """
    if key in dims or key in metrics:
        raise ValueError(f"{key!r} names the range; it cannot be a dimension or a metric too")
    ranges = ranges.select(col(key), *BOUNDS)
    for p in ("current", "previous"):  # an empty period: both days the same
        bad = F.expr(f"CAST({p}_end AS DATE) < CAST({p}_start AS DATE)")
        ranges = ranges.withColumn(f"{p}_start", F.when(bad, F.date_add(F.col(f"{p}_end").cast("date"), 1)).otherwise(F.col(f"{p}_start").cast("date")))
    marks = _range_days(ranges, key)
    first, last = (marks.agg(x.alias("day")) for x in (F.min("at"), F.max("at")))
    marks_known = marks.select("at").distinct().withColumnRenamed("at", "mark")

    by = [col(d) for d in dims]
    order = Window.partitionBy(*by).orderBy(DAY)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [ROWS, *sum_columns(list(metrics))]
    totals = daily.where(F.col(DAY) <= last.scalar()).select(
        *by, DAY, F.date_sub(F.lead(DAY).over(order), 1).alias("__kpi_until"), *[F.sum(col(c)).over(running).alias(c) for c in sums])
    until = F.coalesce("__kpi_until", last.scalar())
    held = (totals.withColumn("__kpi_until", until).where(F.col("__kpi_until") >= first.scalar())
            .withColumn("mark", F.explode(F.sequence(F.greatest(F.col(DAY), first.scalar()), F.col("__kpi_until")))).drop(DAY, "__kpi_until"))
    # first only the days that matter (rows of a group fall to those), then the ranges they belong to
    if few:
        marks_known, marks = F.broadcast(marks_known), F.broadcast(marks)
    met = held.join(marks_known, "mark", "left_semi").join(marks, F.col("mark") == F.col("at"))

    def signed(c, p):  # no product: it would round decimals
        sign = F.col(f"__kpi_{p}")
        return F.coalesce(F.sum(F.when(sign == 1, col(c)).when(sign == -1, -col(c))), F.lit(0)).alias(f"{c}__kpi_{p}")

    aggs = [signed(c, p) for c in sums for p in ("current", "previous")]
    wide = met.groupBy(*by, col(key)).agg(*aggs).where(f"{ROWS}__kpi_current > 0 OR {ROWS}__kpi_previous > 0")

    out = [col(key), *by]
    for m, dtype in metrics.items():
        for p in ("current", "previous"):
            value = col(f"{m}__kpi_{p}").cast(dtype)
            if isinstance(dtype, (T.FloatType, T.DoubleType)):
                nan, up, down = (col(f"{m}__kpi_{k}__kpi_{p}") > 0 for k in _KINDS)
                value = (F.when(nan | (up & down), F.lit(float("nan"))).when(up, F.lit(float("inf")))
                         .when(down, F.lit(float("-inf"))).otherwise(value))
            out.append(value.alias(f"{m}_{p}"))
    return wide.select(*out)


def checked_ranges(ranges: DataFrame, key: str = "range_id") -> tuple:
    """(number, first day, last day) of the ranges (no days without any), after a check for repeated keys."""
    days = [F.col(b).cast("date") for b in BOUNDS]
    n, different, first, last = ranges.agg(F.count(F.lit(1)), F.count_distinct(col(key)), F.min(F.least(*days)), F.max(F.greatest(*days))).first()
    if n != different:
        raise ValueError(f"the values of {key!r} must be different and not null")
    return n, first, last
