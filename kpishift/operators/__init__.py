"""DataFrame-level operators of the report pipeline."""

from .aggregate import aggregate_by_dimensions, aggregate_periods, metric_list
from .derive import compute_all_derived_metrics, compute_derived_metric
from .joins import join_periods, join_sources
from .periods import detect_date_pattern, flag_periods, parse_date_column, split_by_period
from .present import insight_table, kpi_cards, narrative
from .profile import column_profile, suggested_ranges
from .rank import number_rows, rank_insights
from .summary import dimension_breakdown, insight_summary, period_totals
from .unpivot import extract_insights

__all__ = [
    "aggregate_by_dimensions", "aggregate_periods", "metric_list", "compute_all_derived_metrics",
    "compute_derived_metric", "join_periods", "join_sources", "detect_date_pattern", "flag_periods",
    "parse_date_column", "split_by_period", "insight_table", "kpi_cards", "narrative", "column_profile",
    "suggested_ranges", "number_rows", "rank_insights", "dimension_breakdown", "insight_summary",
    "period_totals", "extract_insights",
]
