"""End-to-end plans built from the operators."""

from .report import ReportTables, build_report, period_aggregate, prepare_facts, run_report

__all__ = ["ReportTables", "build_report", "period_aggregate", "prepare_facts", "run_report"]
