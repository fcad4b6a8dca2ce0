from kpishift.__main__ import main

from .fixtures import CLICKS_CSV, CONFIG_A


def test_cli_report_writes_all_tables(spark, tmp_path):
    cfg = tmp_path / "cfg.yaml"
    cfg.write_text(CONFIG_A.format(clicks=CLICKS_CSV))
    out = tmp_path / "out"
    assert main(["report", str(cfg), "--out", str(out)]) == 0
    for name in ("insights", "summary", "meta", "totals", "breakdown", "cards", "table", "narrative"):
        assert (out / name).exists(), name
    assert spark.read.parquet(str(out / "insights")).count() == 20


def test_cli_payload_json(spark, tmp_path):
    cfg = tmp_path / "cfg.yaml"
    cfg.write_text(CONFIG_A.format(clicks=CLICKS_CSV))
    out = tmp_path / "out"
    assert main(["report", str(cfg), "--out", str(out), "--payload"]) == 0
    doc = spark.read.json(str(out / "payload")).first()
    assert len(doc.insights) == 20 and doc.summary.total_insights == 20
    assert doc.insights[0].metric == "impressions" and doc.config.kpis[0] == "ctr"
