"""Derived-metric formulas: ``identifier operator identifier``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the formula grammar (one identifier, one of + - * /, one identifier).
FORMULA_PATTERN = re.compile(r"^\s*(\w+)\s*([+\-*/])\s*(\w+)\s*$")


def read_formulas(formulas: dict[str, str] | None) -> dict[str, tuple[str, str, str]]:
    """``{name: (left, operator, right)}`` in config order; all unreadable ones are named at once.

    No constants, parentheses or longer chains: a digit token is an operand
    name like any other, and must be a column.
    """
    found = {name: FORMULA_PATTERN.fullmatch(str(text or "")) for name, text in (formulas or {}).items()}
    bad = [name for name, m in found.items() if m is None]
    if bad:
        raise ValueError(f"a formula is two names with one of + - * / between them; not so: {', '.join(bad)}")
    return {name: m.groups() for name, m in found.items()}


def check_operands(formulas: dict[str, tuple[str, str, str]], columns: list[str]) -> None:
    """Every operand is a column, or the result of an earlier formula."""
    known = set(columns)
    for name, (left, _, right) in formulas.items():
        unknown = sorted({left, right} - known)
        if unknown:
            raise ValueError(f"derived metric {name!r} uses {', '.join(unknown)}, which is no column at that point")
        known.add(name)


def combine(left: Column, op: str, right: Column) -> Column:
    """Both operands as double; ``/`` gives 0.0 when the divisor is 0 or null.

    The division sits inside the ``CASE`` branch, so ANSI mode never sees a
    zero divisor. A null numerator over a non-zero divisor stays null;
    ``+ - *`` propagate nulls.
    """
    a, b = left.cast("double"), right.cast("double")
    if op == "/":
        return F.when(b != 0, a / b).otherwise(F.lit(0.0))
    return {"+": a + b, "-": a - b, "*": a * b}[op]
