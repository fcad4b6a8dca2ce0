"""Command line: ``python -m kpishift report CONFIG --out DIR`` / ``profile PATH``.

``report`` runs a report definition and writes its tables (insights,
summary, meta, plus totals, breakdown and display tables) under ``--out``;
``profile`` prints column roles and suggested comparison periods for a
CSV or Parquet input.
"""

from __future__ import annotations

import argparse
import json
import sys

from .config import load_config
from .operators.profile import column_profile, suggested_ranges
from .plans.report import run_report
from .session import apply_recommended, local_session
from .sources.files import read_csv, read_parquet
from .sources.sinks import write_report


def _session(args):
    if args.master:
        return local_session(args.master.removeprefix("local[").removesuffix("]") if args.master.startswith("local")
                             else "*")
    from pyspark.sql import SparkSession
    spark = SparkSession.builder.getOrCreate()
    apply_recommended(spark)  # only options that the session does not set itself
    return spark


def cmd_report(args) -> int:
    spark = _session(args)
    tables = run_report(spark, load_config(args.config), base_path=args.base_path)
    paths = write_report(tables, args.out, fmt=args.format,
                         extra=("totals", "breakdown", "cards", "table", "narrative"))
    if args.payload:
        from .sources.sinks import report_pages, report_payload, write_table
        name, build = ("payload", report_payload) if tables.top_n else ("pages", report_pages)
        target = f"{args.out.rstrip('/')}/{name}"
        write_table(build(tables), target, "json", "overwrite")
        paths[name] = target
    print(json.dumps(paths))
    if args.show:
        tables.insights_ordered().show(args.show, truncate=False)
    return 0


def cmd_profile(args) -> int:
    spark = _session(args)
    df = read_parquet(spark, args.path) if args.path.endswith(".parquet") else read_csv(spark, args.path)
    prof = column_profile(df)
    prof.orderBy("ordinal").show(truncate=False)
    dates = [r.column_name for r in prof.where("role = 'date'").select("column_name").collect()]
    if dates:
        suggested_ranges(df, dates[0]).show(truncate=False)
    return 0


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="kpishift")
    ap.add_argument("--master", default=None, help="e.g. local[8]; default: the ambient session")
    sub = ap.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("report")
    r.add_argument("config")
    r.add_argument("--out", required=True)
    r.add_argument("--base-path", default="")
    r.add_argument("--format", default="parquet", choices=["parquet", "json", "orc"])
    r.add_argument("--show", type=int, default=0)
    r.add_argument("--payload", action="store_true", help="also write one JSON document per report (without top_n: one per page of 1,000 insights)")
    r.set_defaults(fn=cmd_report)
    p = sub.add_parser("profile")
    p.add_argument("path")
    p.set_defaults(fn=cmd_profile)
    args = ap.parse_args(argv)
    return args.fn(args)


if __name__ == "__main__":
    sys.exit(main())
