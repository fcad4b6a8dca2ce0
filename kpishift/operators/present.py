"""Display tables built from the ranked insights (cards, table rows, narrative)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import qi
from ..functions.text import (bullet_text_sql, change_text_sql, fmt_fixed_sql, impact_bar_sql, segment_text_sql,
                              sql_str, trend_text_sql, value_str_sql, value_text_sql)

# Rows shown per table and the rule-based narrative wording.
CARD_ROWS = 4
TABLE_ROWS = 6
BULLET_ROWS = 3
NARRATIVE_TITLE = "Performance Analysis Report"
HEADLINE_PREFIX = "Key Finding: "
HEADLINE_UP = "increased"
HEADLINE_DOWN = "decreased"
HEADLINE_SUFFIX = "% in the current period."
HEADLINE_STABLE = "Performance metrics remained stable across the analysis period."
BULLET_PAD = "Additional analysis pending."
RECOMMEND_UP = ("Continue monitoring {metric} performance and identify factors contributing to the "
                "positive trend.")
RECOMMEND_DOWN = "Investigate the decline in {metric} and implement corrective measures to reverse the trend."
RECOMMEND_NONE = "Continue monitoring key metrics for emerging trends."


def _dim_values(dims: list[str], dim_types: dict | None) -> list[tuple[str, str]]:
    return [(d, value_str_sql(qi(d), (dim_types or {}).get(d))) for d in dims]


def kpi_cards(ranked: DataFrame, keys: list[str] = ()) -> DataFrame:
    """First 4 ranks: metric, humanised current value, trend text."""
    return ranked.where(f"rank <= {CARD_ROWS}").selectExpr(
        *[qi(k) for k in keys], "rank", "metric",
        f"{value_text_sql('current_value')} AS value_text",
        f"{trend_text_sql('direction', 'delta_pct')} AS trend_text",
    )


def insight_table(ranked: DataFrame, dims: list[str], keys: list[str] = (), dim_types: dict | None = None) -> DataFrame:
    """First 6 ranks: segment, METRIC, change, impact bar."""
    return ranked.where(f"rank <= {TABLE_ROWS}").selectExpr(
        *[qi(k) for k in keys], "rank",
        f"{segment_text_sql(_dim_values(dims, dim_types), ': ')} AS segment",
        "upper(metric) AS metric",
        f"{change_text_sql('direction', 'delta_pct')} AS change",
        f"{impact_bar_sql('impact_score')} AS impact",
    )


def _fill_sql(template: str, metric: str) -> str:
    head, tail = template.split("{metric}")
    return f"concat({sql_str(head)}, {metric}, {sql_str(tail)})"


def narrative(ranked: DataFrame, dims: list[str], keys: list[str] = (), dim_types: dict | None = None) -> DataFrame:
    """Rule-based narrative per report: title, headline, 3 bullets, recommendation.

    Reads at most 3 rows per key (the bullets) plus the top row; one output
    row per key, or exactly one row without keys (also for no insights).
    """
    keys = list(keys)
    seg = segment_text_sql(_dim_values(dims, dim_types), "=")
    bullet = bullet_text_sql("metric", seg, "current_value", "previous_value", "delta_pct")
    head = ranked.where(f"rank <= {BULLET_ROWS}")
    aggs = [
        F.expr("min_by(named_struct('metric', metric, 'direction', direction, 'delta_pct', delta_pct), rank)")
        .alias("_top"),
        F.expr(f"sort_array(collect_list(named_struct('rank', rank, 'text', {bullet})))").alias("_b"),
    ]
    g = head.groupBy(*[F.col(qi(k)) for k in keys]).agg(*aggs) if keys else head.agg(*aggs)
    verb = f"(CASE WHEN _top.direction = 'up' THEN {sql_str(HEADLINE_UP)} ELSE {sql_str(HEADLINE_DOWN)} END)"
    headline = (f"(CASE WHEN _top IS NULL THEN {sql_str(HEADLINE_STABLE)} ELSE concat({sql_str(HEADLINE_PREFIX)}, "
                f"upper(_top.metric), ' ', {verb}, ' by ', {fmt_fixed_sql('abs(_top.delta_pct)', 1)}, "
                f"{sql_str(HEADLINE_SUFFIX)}) END)")
    recommendation = (f"(CASE WHEN _top IS NULL THEN {sql_str(RECOMMEND_NONE)} "
                      f"WHEN _top.direction = 'up' THEN {_fill_sql(RECOMMEND_UP, '_top.metric')} "
                      f"ELSE {_fill_sql(RECOMMEND_DOWN, '_top.metric')} END)")
    texts = "transform(coalesce(_b, array()), s -> s.text)"
    bullets = (f"concat({texts}, array_repeat({sql_str(BULLET_PAD)}, "
               f"greatest({BULLET_ROWS} - size({texts}), 0)))")
    return g.selectExpr(
        *[qi(k) for k in keys],
        f"{sql_str(NARRATIVE_TITLE)} AS title",
        f"{headline} AS headline",
        f"{bullets} AS bullets",
        f"{recommendation} AS recommendation",
    )
