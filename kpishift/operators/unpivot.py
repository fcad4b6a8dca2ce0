"""Wide period aggregate -> one scored row per (dimension tuple x KPI)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import chain, qi, round_stages
from ..functions.scoring import (IMPACT_DIGITS, PCT_DIGITS, VALUE_DIGITS, delta_pct_sql, delta_sql,
                                 direction_sql, raw_impact_sql)

INSIGHT_VALUE_COLUMNS = ["metric", "kpi_index", "current_value", "previous_value", "delta", "delta_pct",
                         "impact_score", "direction"]


def present_kpis(columns: list[str], kpis: list[str]) -> list[tuple[int, str]]:
    """(priority index, KPI) for KPIs that have both period columns."""
    return [(i, k) for i, k in enumerate(kpis) if f"{k}_current" in columns and f"{k}_previous" in columns]


def score_rows(joined: DataFrame, dims: list[str], kpis: list[str], keys: list[str] = ()) -> DataFrame:
    """Unpivot with ``stack`` (narrow, no shuffle) after scoring every KPI.

    Output: keys, dims, metric, kpi_index, the unrounded ``__kpi_c, __kpi_p, __kpi_d, __kpi_dp``,
    ``impact_score`` (rounded: it orders and filters the rows) and
    ``direction``. Impact uses the unrounded delta and delta %; ``N`` in the
    priority weight is the number of configured KPIs, also when some are
    absent. :func:`finish_insights` rounds the remaining values, after any
    top-N, so that work is done on the kept rows only.
    """
    group = list(keys) + list(dims)
    kpis = list(kpis)
    present = present_kpis(joined.columns, kpis)
    n_kpis = len(kpis)
    if not present:
        return joined.select(
            *group,
            F.lit(None).cast("string").alias("metric"), F.lit(None).cast("int").alias("kpi_index"),
            *[F.lit(None).cast("double").alias(c) for c in ("__kpi_c", "__kpi_p", "__kpi_d", "__kpi_dp", "impact_score")],
            F.lit(None).cast("string").alias("direction"),
        ).where(F.lit(False))
    g = [qi(c) for c in group]
    # Score every KPI in the wide row first, then unpivot the scored values.
    # Filters on the scores (min impact) sit above the ``stack`` and cannot
    # be pushed below it, so they never expand into copies of the scoring
    # expressions; each stage reads plain column references. All stages
    # are one nested query (parsed and analysed once).
    wide = g + [e for i, k in present for e in (
        f"coalesce(CAST({qi(k + '_current')} AS DOUBLE), 0.0D) AS __kpi_c{i}",
        f"coalesce(CAST({qi(k + '_previous')} AS DOUBLE), 0.0D) AS __kpi_p{i}")]
    changes = ["*"] + [e for i, _ in present for e in (
        f"{delta_sql(f'__kpi_c{i}', f'__kpi_p{i}')} AS __kpi_d{i}", f"{delta_pct_sql(f'__kpi_c{i}', f'__kpi_p{i}')} AS __kpi_dp{i}")]
    raw = ["*"] + [e for i, _ in present for e in (
        f"{raw_impact_sql(f'__kpi_d{i}', f'__kpi_dp{i}', str(i), n_kpis)} AS __kpi_imp{i}", f"{direction_sql(f'__kpi_d{i}')} AS __kpi_dr{i}")]
    keep = list(group) + [c for i, _ in present for c in (f"__kpi_c{i}", f"__kpi_p{i}", f"__kpi_d{i}", f"__kpi_dp{i}", f"__kpi_dr{i}")]
    rounding = round_stages([(f"__kpi_imp{i}", IMPACT_DIGITS, f"__kpi_im{i}") for i, _ in present], keep)
    stack = ", ".join(f"'{k}', {i}, __kpi_c{i}, __kpi_p{i}, __kpi_d{i}, __kpi_dp{i}, __kpi_im{i}, __kpi_dr{i}" for i, k in present)
    unpivot = g + [f"stack({len(present)}, {stack}) AS (metric, kpi_index, __kpi_c, __kpi_p, __kpi_d, __kpi_dp, impact_score, direction)"]
    return chain(joined, [wide, changes, raw, *rounding, unpivot])


def finish_insights(scored: DataFrame) -> DataFrame:
    """Round values and delta to 4 decimals, delta % to 2 (Python's rounding)."""
    front = [c for c in scored.columns if c not in ("__kpi_c", "__kpi_p", "__kpi_d", "__kpi_dp", "impact_score", "direction")]
    specs = [("__kpi_c", VALUE_DIGITS, "current_value"), ("__kpi_p", VALUE_DIGITS, "previous_value"),
             ("__kpi_d", VALUE_DIGITS, "delta"), ("__kpi_dp", PCT_DIGITS, "delta_pct")]
    order = [c for c in front if c != "rank"] + INSIGHT_VALUE_COLUMNS[2:] + (["rank"] if "rank" in front else [])
    return chain(scored, [*round_stages(specs, front + ["impact_score", "direction"]), [qi(c) for c in order]])


def extract_insights(joined: DataFrame, dims: list[str], kpis: list[str], keys: list[str] = ()) -> DataFrame:
    """One scored row per (dimension tuple x KPI), all values rounded."""
    return finish_insights(score_rows(joined, dims, kpis, keys))


__all__ = ["extract_insights", "score_rows", "finish_insights", "present_kpis", "INSIGHT_VALUE_COLUMNS"]
