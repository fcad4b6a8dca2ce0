"""Period-comparison KPI insights on Spark DataFrames."""

from .config import ConfigError, InsightConfig, config_from_dict, load_config, load_config_from_string
from .operators.profile import column_profile, suggested_ranges
from .plans.report import ReportTables, run_report
from .sources.sinks import report_payload, write_report
from .streaming import file_stream, stream_report

__all__ = ["ConfigError", "InsightConfig", "config_from_dict", "load_config", "load_config_from_string",
           "ReportTables", "run_report", "write_report", "report_payload", "column_profile", "suggested_ranges",
           "file_stream", "stream_report"]
