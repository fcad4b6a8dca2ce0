"""Ranking by impact: global top-N, top-N per report key, or a full ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import col, qi
from ..session import cut_lineage

RANK = "rank"


def rank_order(dims: list[str]) -> list[Column]:
    """Impact descending; ties by KPI priority, then dimension values (a total order)."""
    return [F.col("impact_score").desc(), F.col("kpi_index").asc(),
            *[col(d).asc_nulls_first() for d in dims]]


def min_impact_filter(df: DataFrame, min_impact: float = 0.0) -> DataFrame:
    """``impact >= min_impact``; NaN never passes (Spark would order it first)."""
    return df.where(f"impact_score >= {float(min_impact)!r}D AND NOT isnan(impact_score)")


GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def allow_group_limit(spark: SparkSession, n: int) -> None:
    """Let Spark cut every key to ``n`` rows before the shuffle, also above its default of 1000.

    Only raises the session's option, never lowers it.
    """
    if 0 <= int(spark.conf.get(GROUP_LIMIT, "1000")) < n:
        spark.conf.set(GROUP_LIMIT, str(n))


def rank_insights(insights: DataFrame, dims: list[str], top_n: int | None = None, min_impact: float = 0.0,
                  keys: list[str] = (), partitions: int | None = None) -> DataFrame:
    """Filter, order and number (``rank`` from 1); keep ``top_n`` (falsy = all).

    * global top-N: ``orderBy().limit()`` plans as TakeOrderedAndProject
      (per-partition top-N, then a merge of at most N x partitions rows);
      numbering the N survivors is a window over N rows.
    * per report key: ``row_number`` over ``partitionBy(keys)`` with
      ``rank <= N`` plans as WindowGroupLimit for any N (see
      :func:`allow_group_limit`), which cuts every key to N rows per map task
      before the shuffle, so a hot key cannot swamp one task.
    * no limit: :func:`number_rows` (range partitioning, no single task); ranks
      are then ``bigint``.
    """
    keys = list(keys)
    order = rank_order(dims)
    kept = min_impact_filter(insights, min_impact)
    if keys:
        if top_n:
            allow_group_limit(insights.sparkSession, int(top_n))
            w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*order)
            return kept.withColumn(RANK, F.row_number().over(w)).where(F.col(RANK) <= top_n)
        return number_rows(kept, order, keys, partitions=partitions)
    if top_n:
        top = kept.orderBy(*order).limit(int(top_n))
        return top.withColumn(RANK, F.row_number().over(Window.orderBy(*order)))
    return number_rows(kept, order, [], partitions=partitions)


def number_rows(df: DataFrame, order: list[Column], keys: list[str], out: str = RANK,
                partitions: int | None = None) -> DataFrame:
    """Consecutive 1-based numbers in ``order`` (within each key) for any size.

    Range-partition on (keys, order), sort inside each partition, and
    checkpoint the result (see below): every
    partition holds one contiguous slice of the order, and a hot key spreads
    over many partitions. ``monotonically_increasing_id`` then carries each
    row's position inside its partition, so no further shuffle is needed to
    number rows locally. One small aggregate gives, per (partition, key)
    slice, its first position and size; a window over those slices adds the
    sizes of earlier partitions. Without keys that table has at most one row
    per partition and is broadcast; with keys it is joined on (partition, key).
    """
    sort_cols = [col(k).asc_nulls_first() for k in keys] + list(order)
    ranged = df.repartitionByRange(partitions, *sort_cols) if partitions else df.repartitionByRange(*sort_cols)
    ranged = (ranged.sortWithinPartitions(*sort_cols)
              .withColumn("__kpi_pid", F.spark_partition_id())
              .withColumn("__kpi_pos", F.monotonically_increasing_id()))
    # The frame is read twice below (slice sizes, and the rows themselves).
    # Range bounds come from a random sample, so two evaluations could cut
    # partitions differently; a reliable checkpoint fixes one partitioning
    # (and spares the second read a recomputation of everything upstream).
    ranged = cut_lineage(ranged)
    mine = [f"__kpi_key_{i}" for i in range(len(keys))]  # names of their own: a self-join resolves equal ones again, without quotes
    slices = ranged.groupBy(F.col("__kpi_pid"), *[col(k).alias(m) for k, m in zip(keys, mine)]).agg(F.min("__kpi_pos").alias("__kpi_first"), F.count(F.lit(1)).alias("__kpi_n"))
    before = Window.partitionBy(*mine).orderBy("__kpi_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select("__kpi_pid", *mine, "__kpi_first",
                            F.coalesce(F.sum("__kpi_n").over(before), F.lit(0)).alias("__kpi_off"))
    if not keys:
        offsets = F.broadcast(offsets)  # one row per partition of ``ranged``
    o = offsets.alias("_o")
    lft = ranged.alias("_l")
    same = F.col("_l.__kpi_pid") == F.col("_o.__kpi_pid")
    for k, m in zip(keys, mine):
        same = same & F.col(f"_l.{qi(k)}").eqNullSafe(F.col(f"_o.{m}"))
    joined = lft.join(o, same)
    cols = [F.col(f"_l.{qi(c)}") for c in df.columns]
    number = F.col("_l.__kpi_pos") - F.col("_o.__kpi_first") + F.lit(1) + F.col("_o.__kpi_off")
    return joined.select(*cols, number.cast("bigint").alias(out))
