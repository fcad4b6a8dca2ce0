"""One report (or one per report key) as a single lazy plan.

scan -> (join) -> date -> derived metrics -> period filter -> one hash
aggregate with both periods -> stack + score -> top-N -> summary tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import InsightConfig
from ..operators.aggregate import aggregate_by_dimensions, aggregate_periods, metric_list
from ..operators.derive import compute_all_derived_metrics
from ..operators.joins import default_join_keys, join_periods, join_sources
from ..operators.periods import IN_CURRENT, IN_PREVIOUS, flag_periods, parse_date_column, split_by_period
from ..operators.present import insight_table, kpi_cards, narrative
from ..operators.rank import rank_insights
from ..operators.ranges import BROADCAST_RANGES, checked_ranges, daily_sums, range_sums
from ..operators.summary import dimension_breakdown, insight_summary, period_totals
from ..operators.unpivot import finish_insights, score_rows
from ..functions.formulas import read_formulas
from ..functions.numeric import col, qi
from ..session import cut_lineage
from ..sources.ingest import join_loaded, load_all_sources, normalise_dates


class ReportTables:
    """Lazy result tables of one run; nothing executes until one is used.

    ``insights`` (ranked, rank 1..N per key) is the base of every other
    table; those are built on first access only.
    """

    def __init__(self, config: InsightConfig, dims: list, keys: list, facts: Callable[[], DataFrame] | None,
                 periods: DataFrame, raw_scores: DataFrame, dim_types: dict, top_n: int | None):
        self.config = config
        self.dims = dims
        self.keys = keys
        self._facts = facts
        self.periods = periods      # wide aggregate: keys, dims, m_current, m_previous
        self.raw_scores = raw_scores  # every (dims x KPI) row; only the impact rounded yet
        self.dim_types = dim_types
        self.top_n = top_n

    @cached_property
    def facts(self) -> DataFrame:
        """The joined rows, dates normalised, with the derived metrics."""
        if self._facts is None:
            raise ValueError("this report was built from a period aggregate: it has no joined rows")
        return self._facts()

    @cached_property
    def insights(self) -> DataFrame:
        """Ranked on the rounded impact; the other values are rounded on the kept rows only.

        A full ranking (no ``top_n``) writes its sorted rows to the checkpoint
        folder when this is first used, not before.
        """
        rep = self.config.report
        return finish_insights(rank_insights(self.raw_scores, self.dims, top_n=self.top_n, min_impact=rep.min_impact,
                                             keys=self.keys, partitions=rep.ranking_partitions))

    @cached_property
    def scored(self) -> DataFrame:
        """Every (dims x KPI) row, scored and rounded, before filter and ranking."""
        return finish_insights(self.raw_scores)

    @cached_property
    def summary(self) -> DataFrame:
        return insight_summary(self.insights, self.dims, self.keys)

    @cached_property
    def totals(self) -> DataFrame:
        return period_totals(self.periods, metric_list(self.config), self.keys)

    @cached_property
    def breakdown(self) -> DataFrame:
        return dimension_breakdown(self.insights, self.dims, self.keys, self.dim_types)

    @cached_property
    def cards(self) -> DataFrame:
        return kpi_cards(self.insights, self.keys)

    @cached_property
    def table(self) -> DataFrame:
        return insight_table(self.insights, self.dims, self.keys, self.dim_types)

    @cached_property
    def narrative(self) -> DataFrame:
        return narrative(self.insights, self.dims, self.keys, self.dim_types)

    @cached_property
    def meta(self) -> DataFrame:
        rep = self.config.report
        return self.periods.sparkSession.range(1).select(
            F.array(*[F.lit(d) for d in self.dims]).cast("array<string>").alias("dimensions"),
            F.array(*[F.lit(k) for k in rep.kpi_priority]).cast("array<string>").alias("kpis"),
            F.lit(rep.comparison.current_period).alias("current_period"),
            F.lit(rep.comparison.previous_period).alias("previous_period"),
        )

    def insights_ordered(self) -> DataFrame:
        return self.insights.orderBy(*[F.col(qi(k)) for k in self.keys], "rank")

    def materialize(self) -> "ReportTables":
        """Compute the period aggregate once and cut lineage there.

        Every table derives from the period aggregate (one row per group,
        far smaller than the facts). Writing several tables would otherwise
        re-run scan, join and aggregate once per table. The checkpoint is a
        reliable one in ``spark.checkpoint.dir`` (shared storage), so a lost
        executor does not force a rescan; the ranked insights (top-N per key)
        are cut the same way. A full ranking is already cut where it is numbered.
        """
        tables = report_from_periods(self.config, cut_lineage(self.periods), self._facts, self.dim_types, self.top_n)
        if self.top_n:
            tables.insights = cut_lineage(tables.insights)
        return tables


def prepare_facts(loaded: dict[str, DataFrame], config: InsightConfig) -> tuple[DataFrame, str]:
    """(fact table with derived metrics, date column) of loaded sources with normalised dates."""
    fact, date_col = join_loaded(loaded, config)
    if config.derived_metrics:
        fact = compute_all_derived_metrics(fact, config.derived_metrics)
    return fact, date_col


def period_aggregate(fact: DataFrame, config: InsightConfig, date_col: str, plan: str = "fused") -> DataFrame:
    """Wide aggregate ``keys + dims, m_current, m_previous`` for every metric.

    ``fused``: one filtered scan and one hash aggregate with conditional
    sums. ``literal``: aggregate each period separately, then full outer
    join (two aggregates and a join; kept for checks and comparisons).
    """
    rep = config.report
    group = list(rep.report_key) + list(rep.primary_dims)
    metrics = metric_list(config)
    if plan == "literal":
        cur, prev = split_by_period(fact, date_col, rep.comparison)
        return join_periods(aggregate_by_dimensions(cur, group, metrics, rep.accumulator),
                            aggregate_by_dimensions(prev, group, metrics, rep.accumulator), group)
    if plan != "fused":
        raise ValueError(f"Unknown plan: {plan}")
    flagged = flag_periods(fact, date_col, rep.comparison)
    return aggregate_periods(flagged, group, metrics, IN_CURRENT, IN_PREVIOUS, rep.accumulator)


def report_from_periods(config: InsightConfig, periods: DataFrame, facts: Callable[[], DataFrame] | None = None,
                        dim_types: dict | None = None, top_n: int | None = -1) -> ReportTables:
    """Score, rank and summarise an existing wide period aggregate."""
    rep = config.report
    dims = list(rep.primary_dims)
    keys = list(rep.report_key)
    n = rep.top_n if top_n == -1 else top_n
    raw = score_rows(periods, dims, list(rep.kpi_priority), keys)
    if dim_types is None:
        dim_types = {f.name: f.dataType for f in periods.schema.fields if f.name in dims}
    return ReportTables(config, dims, keys, facts, periods, raw, dim_types, n)


def build_report(config: InsightConfig, fact: DataFrame, date_col: str, plan: str = "fused",
                 top_n: int | None = -1) -> ReportTables:
    periods = period_aggregate(fact, config, date_col, plan)
    dims = list(config.report.primary_dims)
    dim_types = {f.name: f.dataType for f in fact.schema.fields if f.name in dims}
    return report_from_periods(config, periods, lambda: fact, dim_types, top_n)


def _formula_operands(config: InsightConfig) -> set[str]:
    return {name for left, _, right in read_formulas(config.derived_metrics).values() for name in (left, right)}


def eager_periods(config: InsightConfig, loaded: dict[str, DataFrame]) -> DataFrame | None:
    """Period aggregate with the primary aggregated *before* the joins, when exact.

    Applies when the secondary sources contribute only dimension / key
    columns (no metric, no formula operand), the joins are left or inner,
    the report date is a primary column and sums are plain doubles. The
    primary is then summed per (join keys, primary-side group columns) with
    the period flags, the secondaries are joined onto those partial sums,
    and a second aggregate sums them per report group. Equal to joining
    first: a key's partial sums are repeated once per matching right row,
    exactly as the key's fact rows would be. The join then shuffles a partial
    sum per key and map task instead of every fact row: worth it where the
    secondaries are too large to broadcast and a key has many fact rows in a
    task; otherwise the extra aggregate costs more than it saves. Returns None
    when not applicable, in particular when a metric or a derived name is also
    a group column or a key of any join (its values would be summed away or
    overwritten before the join reads them).
    """
    rep = config.report
    primary_name = config.dataset.primary_source
    if len(loaded) < 2 or config.dataset.join_type not in ("left", "left_outer", "inner") \
            or rep.accumulator != "double":
        return None
    primary = loaded[primary_name]
    date_col = rep.primary_date_col
    if date_col not in primary.columns:
        return None
    derived_names = set(config.derived_metrics)
    operands = _formula_operands(config)
    if not operands <= set(primary.columns) | derived_names:
        return None
    metrics = metric_list(config)
    keys = default_join_keys(config)
    seen = set(primary.columns) | derived_names
    needed_from_primary, join_keys = set(), set()
    for name, df in loaded.items():
        if name == primary_name:
            continue
        src = config.dataset.sources.get(name)
        wanted = list(src.join_key) if src is not None and src.join_key else keys
        common = [k for k in wanted if k in df.columns and k in seen]
        if not common:
            continue
        extra = [c for c in df.columns if c not in seen]
        if set(extra) & (set(metrics) | operands):
            return None                      # the source brings a metric: join first
        needed_from_primary |= {k for k in common if k in primary.columns}
        join_keys |= set(common)
        seen |= set(extra)
    group = list(rep.report_key) + list(rep.primary_dims)
    if not set(group) <= seen:
        return None
    if (join_keys | needed_from_primary | set(group)) & (set(metrics) | derived_names):
        return None
    pre_keys = [c for c in primary.columns if c in needed_from_primary or c in group]
    if not isinstance(primary.schema[date_col].dataType, T.DateType):
        primary = parse_date_column(primary, date_col)   # a report date other than the source's own
    fact = compute_all_derived_metrics(primary, config.derived_metrics) if config.derived_metrics else primary
    flagged = flag_periods(fact, date_col, rep.comparison)
    partial = aggregate_periods(flagged, pre_keys, metrics, IN_CURRENT, IN_PREVIOUS, "double")
    joined = join_sources({**loaded, primary_name: partial}, config)
    sums = [c for c in partial.columns if c not in pre_keys]
    aggs = [F.coalesce(F.sum(col(c)), F.lit(0)).alias(c) for c in sums]
    if not group:
        return joined.agg(*aggs)
    return joined.groupBy(*[col(g) for g in group]).agg(*aggs)


def run_report(spark: SparkSession, config: InsightConfig, frames: dict | None = None, base_path: str = "",
               plan: str = "fused") -> ReportTables:
    """Validate, ingest and build all report tables (lazy).

    ``frames`` maps source names to ready DataFrames (used instead of
    reading the configured location). Sources are loaded once and joined
    before the aggregate; with ``pre_aggregate: true`` in the dataset the
    primary is aggregated before the joins whenever that gives the same
    result (see :func:`eager_periods`).
    """
    config.validate()
    loaded = normalise_dates(load_all_sources(spark, config, base_path, frames), config)
    if plan == "fused" and config.dataset.pre_aggregate:
        periods = eager_periods(config, loaded)
        if periods is not None:
            return report_from_periods(config, periods, lambda: prepare_facts(loaded, config)[0])
    return build_report(config, *prepare_facts(loaded, config), plan)


def sum_type(dtype: T.DataType) -> T.DataType:
    """The type of a plain sum over a column of ``dtype``."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return T.DoubleType()
    if isinstance(dtype, T.DecimalType):
        return T.DecimalType(min(38, dtype.precision + 10), dtype.scale)
    return T.LongType()


def range_metrics(fact: DataFrame, config: InsightConfig) -> dict[str, T.DataType]:
    """The report's metrics among the columns of ``fact``, with the types of their sums."""
    group = [*config.report.report_key, *config.report.primary_dims]
    types = {f.name: f.dataType for f in fact.schema.fields}
    return {m: sum_type(types[m]) for m in metric_list(config) if m in types and m not in group}


def run_range_report(spark: SparkSession, config: InsightConfig, ranges: DataFrame, frames: dict | None = None,
                     base_path: str = "", key: str = "range_id", daily: tuple[DataFrame, dict] | None = None) -> ReportTables:
    """One report per row of ``ranges`` (``key``, current_start, current_end, previous_start, previous_end) in one scan.

    The report's own comparison is not used; ``key`` becomes the first report key.
    ``daily``: kept daily sums and their metrics' types, instead of a scan
    (see :class:`kpishift.sources.kept.KeptDays`).
    """
    config.validate()
    group = [*config.report.report_key, *config.report.primary_dims]
    n, first, last = checked_ranges(ranges, key)
    if daily is None:
        fact, date_col = prepare_facts(normalise_dates(load_all_sources(spark, config, base_path, frames), config), config)
        if first is not None:
            fact = fact.where((col(date_col) >= F.lit(first)) & (col(date_col) <= F.lit(last)))  # reaches the scan
        types = range_metrics(fact, config)
        days = daily_sums(fact, date_col, group, list(types))
    else:
        days, types = daily
    periods = range_sums(days, group, types, ranges, key, few=n <= BROADCAST_RANGES)
    own = replace(config, report=replace(config.report, report_key=[key, *config.report.report_key]))
    return report_from_periods(own, periods)


__all__ = ["ReportTables", "run_report", "run_range_report", "range_metrics", "build_report", "report_from_periods", "prepare_facts", "period_aggregate"]
