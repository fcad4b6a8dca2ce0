"""Derived metrics (row-wise ``a op b``), applied in config order."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.formulas import check_operands, combine, read_formulas
from ..functions.numeric import col


def compute_all_derived_metrics(df: DataFrame, derived: dict[str, str] | None) -> DataFrame:
    """Add (or overwrite) every derived column; later formulas may use earlier results.

    Each step is a projection; Catalyst collapses them into one, so the
    chain costs nothing beyond the expressions themselves.
    """
    formulas = read_formulas(derived)
    check_operands(formulas, df.columns)
    for name, (left, op, right) in formulas.items():
        df = df.withColumn(name, combine(col(left), op, col(right)))
    return df


def compute_derived_metric(df: DataFrame, name: str, formula: str) -> DataFrame:
    """Add (or overwrite) column ``name`` computed from ``formula``."""
    return compute_all_derived_metrics(df, {name: formula})
