"""Display strings for insight rows (cards, table cells, bullets, headlines).

Each helper returns Spark SQL text over column expressions (one JVM call to
use it). Numbers are rounded with Python's rounding first, so the digits
equal Python's format specs (``:.1f``, ``:+.1f``, ``:,.2f``) exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numeric import exact_round_sql

# Arrows, bar glyph and the bar length rule (5 glyphs per unit, at most 10).
ARROW_UP = "↑"
ARROW_DOWN = "↓"
ARROW_FLAT = "→"
BAR_GLYPH = "█"
BAR_PER_UNIT = 5
BAR_MAX = 10
OVERALL = "Overall"


def sql_str(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fmt_fixed_sql(expr: str, digits: int, sign: bool = False) -> str:
    """``f"{x:.{digits}f}"`` (``+`` flag when ``sign``)."""
    pattern = "%" + ("+" if sign else "") + f".{digits}f"
    return f"format_string('{pattern}', {exact_round_sql(expr, digits)})"


def fmt_thousands_sql(expr: str) -> str:
    """``f"{x:,.2f}"``."""
    return f"format_number({exact_round_sql(expr, 2)}, 2)"


def value_text_sql(value: str) -> str:
    """1.2M / 3.4K / 567 (F8)."""
    return (f"(CASE WHEN {value} >= 1000000 THEN concat({fmt_fixed_sql(f'{value} / 1000000.0D', 1)}, 'M') "
            f"WHEN {value} >= 1000 THEN concat({fmt_fixed_sql(f'{value} / 1000.0D', 1)}, 'K') "
            f"ELSE {fmt_fixed_sql(value, 0)} END)")


def trend_text_sql(direction: str, pct: str) -> str:
    """``↑ +x.x%`` / ``↓ x.x%`` / ``→ x.x%`` (F9)."""
    head = (f"(CASE WHEN {direction} = 'up' THEN '{ARROW_UP} +' WHEN {direction} = 'down' THEN '{ARROW_DOWN} ' "
            f"ELSE '{ARROW_FLAT} ' END)")
    return f"concat({head}, {fmt_fixed_sql(pct, 1)}, '%')"


def arrow_sql(direction: str) -> str:
    return (f"(CASE WHEN {direction} = 'up' THEN '{ARROW_UP}' WHEN {direction} = 'down' THEN '{ARROW_DOWN}' "
            f"ELSE '{ARROW_FLAT}' END)")


def change_text_sql(direction: str, pct: str) -> str:
    """Arrow and signed one-decimal percentage, e.g. ``↓ -12.8%`` (F10)."""
    return f"concat({arrow_sql(direction)}, ' ', {fmt_fixed_sql(pct, 1, sign=True)}, '%')"


def impact_bar_sql(impact: str) -> str:
    """``█`` x min(int(5 * impact), 10), a space, impact with 2 decimals (F10)."""
    n = f"CAST(floor(least(greatest({impact} * {float(BAR_PER_UNIT)!r}D, 0.0D), {float(BAR_MAX)!r}D)) AS INT)"
    return f"concat(repeat('{BAR_GLYPH}', {n}), ' ', {fmt_fixed_sql(impact, 2)})"


def value_str_sql(expr: str, dtype: T.DataType | None = None) -> str:
    """Dimension value as text; null prints as ``None``, booleans as ``True``/``False``."""
    if isinstance(dtype, T.BooleanType):
        s = f"(CASE WHEN {expr} THEN 'True' WHEN NOT {expr} THEN 'False' END)"
    else:
        s = f"CAST({expr} AS STRING)"
    return f"coalesce({s}, 'None')"


def segment_text_sql(dims: list[tuple[str, str]], sep: str = ": ") -> str:
    """``k: v, k: v`` or ``Overall`` without dimensions (F11; F12 uses ``=``).
    ``dims`` pairs a dimension name with the SQL of its value text."""
    if not dims:
        return sql_str(OVERALL)
    parts = [f"concat({sql_str(name + sep)}, {val})" for name, val in dims]
    return f"concat_ws(', ', {', '.join(parts)})"


def bullet_text_sql(metric: str, segment: str, current: str, previous: str, pct: str) -> str:
    """``METRIC for k=v: 1,234.00 → 1,000.00 (+23.4%)`` (F12)."""
    return (f"concat(upper({metric}), ' for ', {segment}, ': ', {fmt_thousands_sql(current)}, ' → ', "
            f"{fmt_thousands_sql(previous)}, ' (', {fmt_fixed_sql(pct, 1, sign=True)}, '%)')")


# Column wrappers over column names, for use in DataFrame code.
def value_text(col: str) -> Column:
    return F.expr(value_text_sql(col))


def trend_text(direction: str, pct: str) -> Column:
    return F.expr(trend_text_sql(direction, pct))


def change_text(direction: str, pct: str) -> Column:
    return F.expr(change_text_sql(direction, pct))


def impact_bar(impact: str) -> Column:
    return F.expr(impact_bar_sql(impact))


def value_str(col: str, dtype: T.DataType | None = None) -> Column:
    return F.expr(value_str_sql(col, dtype))
