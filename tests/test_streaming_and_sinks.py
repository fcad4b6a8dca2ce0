import uuid

from kpishift import config_from_dict
from kpishift.plans.catalog import flagship_config, flagship_report, q_streaming_flagship
from kpishift.session import scratch_path
from kpishift.sources.sinks import write_report
from kpishift.streaming import file_stream, streaming_periods

from .conftest import SF_SMALL

COLS = ["l_returnflag", "l_linestatus", "metric", "current_value", "previous_value", "delta", "delta_pct",
        "impact_score", "direction", "rank"]


def _rows(df):
    return sorted(tuple(r[c] for c in COLS) for r in df.collect())


def test_streaming_equals_batch(spark):
    assert _rows(q_streaming_flagship(spark, SF_SMALL)) == _rows(flagship_report(spark, SF_SMALL).insights)


def test_streaming_plan_is_stateful_aggregate(spark):
    cfg = config_from_dict(flagship_config(SF_SMALL))
    periods = streaming_periods(cfg, file_stream(spark, f"{SF_SMALL}/lineitem.parquet"))
    assert periods.isStreaming
    assert set(periods.columns) >= {"unit_price_current", "unit_price_previous"}


def test_write_report_round_trip(spark):
    rep = flagship_report(spark, SF_SMALL)
    out = write_report(rep, scratch_path(spark, f"sink/{uuid.uuid4().hex}"))
    back = spark.read.parquet(out["insights"])
    assert back.count() == rep.insights.count()
    first = back.orderBy("rank").first()
    assert set(first.dimensions) == {"l_returnflag", "l_linestatus"}
    meta = spark.read.parquet(out["meta"]).first()
    assert meta.current_period == "1998-01-01 to 1998-12-31" and list(meta.kpis)[0] == "unit_price"
    summ = spark.read.parquet(out["summary"]).first()
    assert summ.total_insights == back.count()


def test_materialize_scans_facts_once(spark):
    rep = flagship_report(spark, SF_SMALL).materialize()
    for df in (rep.insights, rep.summary, rep.totals, rep.narrative):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FileScan" not in plan and "Scan parquet" not in plan
    assert rep.insights.count() == flagship_report(spark, SF_SMALL).insights.count()


def test_payload_one_row_per_report(spark):
    import json

    from kpishift.plans.catalog import per_nation_report
    from kpishift.sources.sinks import report_payload

    rep = flagship_report(spark, SF_SMALL)
    p = report_payload(rep).collect()
    assert len(p) == 1
    doc = json.loads(report_payload(rep).toJSON().first())
    ins = doc["insights"]
    assert len(ins) == rep.insights.count()
    assert ins[0]["impact_score"] >= ins[-1]["impact_score"]
    assert set(ins[0]["dimensions"]) == {"l_returnflag", "l_linestatus"}
    assert doc["summary"]["total_insights"] == len(ins)
    assert doc["summary"]["top_mover"] == ins[0]
    assert doc["config"]["current_period"] == "1998-01-01 to 1998-12-31"
    per = report_payload(per_nation_report(spark, SF_SMALL))
    assert per.count() == per.select("n_name").distinct().count()
    assert max(len(r.insights) for r in per.collect()) <= 5


def test_streaming_per_report_key(spark):
    from kpishift.plans.catalog import per_nation_config, per_nation_frames
    from kpishift.plans.report import run_report
    from kpishift.streaming import published, stream_report

    # stream the joined facts of the per-nation report, written once as files
    frames = per_nation_frames(spark, SF_SMALL)
    cfg = config_from_dict(per_nation_config())
    facts = run_report(spark, cfg, frames).facts
    src = scratch_path(spark, f"facts/{uuid.uuid4().hex}")
    facts.write.parquet(src)
    single = config_from_dict({**per_nation_config(), "dataset": {"primary_source": "orders", "sources": {
        "orders": {"type": "parquet", "path": src, "date_col": "o_orderdate",
                   "metrics": ["o_totalprice", "order_count"]}}}})
    sink = scratch_path(spark, f"stream_sink/{uuid.uuid4().hex}")
    q = stream_report(single, file_stream(spark, src), sink, checkpoint_location=sink + "_ck")
    q.awaitTermination()
    got = published(spark, sink, "insights")
    want = run_report(spark, cfg, frames=frames).insights
    cols = ["n_name", "c_mktsegment", "metric", "rank", "impact_score", "current_value"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_write_report_partitions_by_report_key(spark):
    import os

    from kpishift.plans.catalog import per_nation_report

    rep = per_nation_report(spark, SF_SMALL)
    out = write_report(rep, scratch_path(spark, f"sink/{uuid.uuid4().hex}"), extra=("totals", "narrative"))
    local = out["insights"].removeprefix("file:")          # checkpoint folders come back as URIs
    parts = [d for d in os.listdir(local) if d.startswith("n_name=")]
    back = spark.read.parquet(out["insights"])
    assert all(len([f for f in os.listdir(os.path.join(local, p)) if f.startswith("part-")]) == 1 for p in parts)
    assert len(parts) == back.select("n_name").distinct().count() > 1
    assert back.count() == rep.insights.count()
    assert spark.read.parquet(out["narrative"]).count() == len(parts)
