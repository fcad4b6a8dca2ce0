"""Column-level building blocks (Spark SQL expressions and Column helpers)."""

from .dates import DATE_PATTERNS, as_date
from .formulas import FORMULA_PATTERN, check_operands, combine, read_formulas
from .numeric import exact_round_sql, round_columns, round_sql, round_to
from .scoring import delta, delta_pct, direction, impact_score
from .text import (bullet_text_sql, change_text, fmt_fixed_sql, fmt_thousands_sql, impact_bar, segment_text_sql,
                   trend_text, value_str, value_text)

__all__ = [
    "DATE_PATTERNS", "as_date", "FORMULA_PATTERN", "check_operands", "combine", "read_formulas", "exact_round_sql",
    "round_columns", "round_sql", "round_to", "delta", "delta_pct", "direction", "impact_score", "bullet_text_sql",
    "change_text", "fmt_fixed_sql", "fmt_thousands_sql", "impact_bar", "segment_text_sql", "trend_text",
    "value_str", "value_text",
]
