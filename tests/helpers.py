import uuid
from contextlib import contextmanager

from kpishift import config_from_dict, run_report


def report_config(dims, kpis, metrics, derived=None, cur=("2025-01-08", "2025-01-14"),
                  prev=("2025-01-01", "2025-01-07"), **report):
    return config_from_dict({
        "dataset": {"primary_source": "f", "sources": {"f": {"type": "table", "table": "f", "date_col": "d",
                                                             "metrics": metrics}}},
        "derived_metrics": derived or {},
        "report": {"primary_date_col": "d", "primary_dims": dims, "kpi_priority": kpis,
                   "comparison": {"current_start": cur[0], "current_end": cur[1],
                                  "previous_start": prev[0], "previous_end": prev[1]}, **report},
    })


def run(spark, df, dims, kpis, metrics, derived=None, plan="fused", **kw):
    cfg = report_config(dims, kpis, metrics, derived, **kw)
    return run_report(spark, cfg, frames={"f": df}, plan=plan)


def by_key(rows, *cols):
    return {tuple(r[c] for c in cols): r for r in rows}


@contextmanager
def jobs_of(spark):
    """Yields a function that counts the Spark jobs started inside the block."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "counted")
    try:
        yield lambda: len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
