"""Date parsing helpers (column level)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# String date formats, tried in this order for a whole column
# (year-month-day with '-', with '/', month/day/year, day/month/year).
DATE_PATTERNS = ("yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "d/M/yyyy")

# Shape of the text each pattern can parse (field ranges included). Checked
# first: a failed parse costs an exception inside the JVM, a regex mismatch
# costs almost nothing, and text outside these shapes cannot parse anyway.
_MONTH = "(0?[1-9]|1[0-2])"
_DAY = "(0?[1-9]|[12][0-9]|3[01])"
_YEAR = "[0-9]{4,}"
PATTERN_SHAPES = {
    "yyyy-M-d": f"^{_YEAR}-{_MONTH}-{_DAY}$",
    "yyyy/M/d": f"^{_YEAR}/{_MONTH}/{_DAY}$",
    "M/d/yyyy": f"^{_MONTH}/{_DAY}/{_YEAR}$",
    "d/M/yyyy": f"^{_DAY}/{_MONTH}/{_YEAR}$",
}

DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def parse_with(col: Column, pattern: str | None) -> Column:
    """Null where the value does not parse; ``None`` means ISO cast."""
    if pattern is None:
        return col.try_cast("date")
    shape = PATTERN_SHAPES.get(pattern)
    parsed = F.try_to_date(col, pattern)
    return F.when(col.rlike(shape), parsed) if shape else parsed


def as_date(col: Column, dtype: T.DataType, pattern: str | None = None) -> Column:
    """Date kept; timestamps truncated to their date; strings parsed."""
    if isinstance(dtype, T.DateType):
        return col
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(col)
    return parse_with(col.cast("string"), pattern)
