"""Change scoring: delta, delta %, impact score, direction.

Each rule is a Spark SQL expression over column names (one JVM call to
build, no Python at run time); the ``Column`` helpers wrap them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import round_sql

# Percentage cap of the impact score, output precisions.
PCT_CAP = 200.0
VALUE_DIGITS = 4
PCT_DIGITS = 2
IMPACT_DIGITS = 4


def _positive(c: str) -> str:
    # Spark orders NaN above every number (NaN > 0 is true); a NaN is neither
    # positive nor negative for the scoring rules.
    return f"({c} > 0 AND NOT isnan({c}))"


def delta_sql(current: str, previous: str) -> str:
    return f"({current} - {previous})"


def delta_pct_sql(current: str, previous: str) -> str:
    """(c - p) / |p| * 100; when p = 0: 0, +100 or -100 by the sign of c."""
    return (f"(CASE WHEN {previous} = 0 THEN (CASE WHEN {current} = 0 THEN 0.0D "
            f"WHEN {_positive(current)} THEN 100.0D ELSE -100.0D END) "
            f"ELSE ({current} - {previous}) / abs({previous}) * 100.0D END)")


def raw_impact_sql(d: str, d_pct: str, kpi_index: str, n_kpis: int) -> str:
    """|d| * (1 + min(|d%|, 200)/200) * (1 + (N - i)/N) on unrounded inputs."""
    n = f"{float(n_kpis)!r}D"
    cap = f"{PCT_CAP!r}D"
    return (f"(abs({d}) * (1.0D + least(abs({d_pct}), {cap}) / {cap}) * "
            f"(1.0D + ({n} - CAST({kpi_index} AS DOUBLE)) / {n}))")


def impact_sql(d: str, d_pct: str, kpi_index: str, n_kpis: int) -> str:
    """The impact score, rounded to 4 decimals."""
    return round_sql(raw_impact_sql(d, d_pct, kpi_index, n_kpis), IMPACT_DIGITS)


def direction_sql(d: str) -> str:
    return f"(CASE WHEN {_positive(d)} THEN 'up' WHEN {d} < 0 THEN 'down' ELSE 'flat' END)"


def delta(current: str, previous: str) -> Column:
    return F.expr(delta_sql(current, previous))


def delta_pct(current: str, previous: str) -> Column:
    return F.expr(delta_pct_sql(current, previous))


def impact_score(d: str, d_pct: str, kpi_index: str, n_kpis: int) -> Column:
    return F.expr(impact_sql(d, d_pct, kpi_index, n_kpis))


def direction(d: str) -> Column:
    return F.expr(direction_sql(d))
