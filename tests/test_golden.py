"""Golden reports over the 84-row sample CSV (values from FIXTURES.md)."""

from kpishift import load_config_from_string, run_report

from .fixtures import CLICKS_CSV, CONFIG_A, CONFIG_B, CONVERSIONS_CSV, GOLDEN_A, GOLDEN_B

COLS = ["campaign", "geo", "metric", "current_value", "previous_value", "delta", "delta_pct", "impact_score",
        "direction"]


def _rows(report):
    return [tuple(r[c] for c in COLS) for r in report.insights.orderBy("rank").collect()]


def _close(got, want):
    # rounding follows Python's round(), so the golden values match exactly
    assert got == want


def test_golden_single_source(spark):
    rep = run_report(spark, load_config_from_string(CONFIG_A.format(clicks=CLICKS_CSV)))
    rows = _rows(rep)
    assert len(rows) == 20
    for got, want in zip(rows, GOLDEN_A):
        _close(got, want)
    tail = rows[16:]
    assert all(r[7] == 0.0 and r[8] == "flat" for r in tail)
    # ties at impact 0: KPI priority, then dimension values
    assert [(r[2], r[0], r[1]) for r in tail] == [
        ("ctr", "Retargeting", "UK"), ("ctr", "Retargeting", "US"),
        ("cpc", "Brand_Awareness", "UK"), ("cpc", "Brand_Awareness", "US")]
    s = rep.summary.first()
    assert s.total_insights == 20 and s.total_gains == 16 and s.total_drops == 0
    assert s.top_mover.metric == "impressions" and s.top_mover.campaign == "Performance_Max"
    assert s.biggest_gain.delta_pct == 46.32 and s.biggest_gain.metric == "impressions"  # better rank wins the tie
    assert s.biggest_drop is None


def test_golden_two_sources(spark):
    cfg = load_config_from_string(CONFIG_B.format(clicks=CLICKS_CSV, conversions=CONVERSIONS_CSV))
    rep = run_report(spark, cfg)
    rows = _rows(rep)
    for got, want in zip(rows, GOLDEN_B):
        _close(got, want)
    # cpa: spend / null conversions -> 0.0, so unmatched rows still count
    facts = rep.facts.where("conversions IS NULL")
    assert facts.count() == 48
    assert {r.cpa for r in facts.select("cpa").distinct().collect()} == {0.0}
    assert facts.where("roas IS NOT NULL").count() == 0


def test_every_source_is_loaded_and_dated_once(spark, monkeypatch):
    import kpishift.operators.periods as periods
    import kpishift.sources.ingest as ingest

    loads, detections = [], []
    read, detect = ingest.load_source, periods.detected_mask
    monkeypatch.setattr(ingest, "load_source", lambda s, name, *a: loads.append(name) or read(s, name, *a))
    monkeypatch.setattr(periods, "detected_mask", lambda df, c: detections.append(c) or detect(df, c))
    for pre in (False, True):
        loads.clear()
        detections.clear()
        text = CONFIG_B.format(clicks=CLICKS_CSV, conversions=CONVERSIONS_CSV)
        text = text.replace("  primary_source: clicks", f"  pre_aggregate: {str(pre).lower()}\n  primary_source: clicks")
        # text dates, so that each source's format is detected
        cfg = load_config_from_string(text.replace('date_col: "date"', 'date_col: "date"\n      options: {inferSchema: "false"}'))
        rep = run_report(spark, cfg)
        assert rep.facts.count() == 84 and rep.insights.count() == 20
        assert sorted(loads) == ["clicks", "conversions"] and len(detections) == 2
