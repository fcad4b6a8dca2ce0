"""One small test per semantics rule."""

import math

import pytest
from pyspark.sql import functions as F

from kpishift.functions.formulas import read_formulas
from kpishift.operators.aggregate import aggregate_by_dimensions, metric_list
from kpishift.operators.derive import compute_all_derived_metrics
from kpishift.operators.joins import join_periods, join_sources
from kpishift.operators.periods import detect_date_pattern, parse_date_column
from kpishift.plans.report import period_aggregate

from .helpers import by_key, report_config, run

SCHEMA = "d string, k string, a double, b double"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def test_q1_ratio_is_summed_per_row(spark):
    df = frame(spark, [("2025-01-09", "x", 1.0, 2.0), ("2025-01-10", "x", 1.0, 4.0)])
    r = run(spark, df, ["k"], ["ratio"], ["a", "b"], {"ratio": "a / b"}).insights.first()
    assert r.metric == "ratio" and r.current_value == 0.75  # 0.5 + 0.25, not 2 / 6


@pytest.mark.parametrize("formula", ["a + b * c", "a / 100", "(a) / b", "a", "a // b"])
def test_q2_formula_grammar(spark, formula):
    df = frame(spark, [("2025-01-09", "x", 1.0, 2.0)])
    with pytest.raises(ValueError):
        compute_all_derived_metrics(df, {"m": formula})


def test_q2_parse():
    assert read_formulas({"ctr": "  clicks/impressions "}) == {"ctr": ("clicks", "/", "impressions")}
    with pytest.raises(ValueError, match="one, two"):
        read_formulas({"one": "a +", "ok": "a + b", "two": ""})


def test_q3_division_and_nulls(spark):
    df = frame(spark, [("1", "zero", 1.0, 0.0), ("2", "nullb", 1.0, None), ("3", "nulla", None, 2.0),
                       ("4", "ok", 1.0, 2.0)])
    out = compute_all_derived_metrics(df, {"q": "a / b", "s": "a + b", "p": "a * b", "m": "a - b"})
    got = by_key(out.collect(), "k")
    assert got[("zero",)].q == 0.0 and got[("nullb",)].q == 0.0
    assert got[("nulla",)].q is None and got[("ok",)].q == 0.5
    assert got[("nullb",)].s is None and got[("nulla",)].p is None and got[("ok",)].m == -1.0


def test_q4_chaining_and_overwrite(spark):
    df = frame(spark, [("1", "x", 3.0, 2.0)])
    out = compute_all_derived_metrics(df, {"c": "a - b", "a": "c * b", "e": "a / c"}).first()
    assert (out.c, out.a, out.e) == (1.0, 2.0, 2.0)


@pytest.mark.parametrize("values,pattern", [
    (["2025-01-02", "2025-1-3", None], "yyyy-M-d"),
    (["2025/01/02"], "yyyy/M/d"),
    (["01/02/2025", "12/31/2025"], "M/d/yyyy"),
    (["13/02/2025", "01/02/2025"], "d/M/yyyy"),
])
def test_q5_whole_column_format(spark, values, pattern):
    df = spark.createDataFrame([(v,) for v in values], "d string")
    assert detect_date_pattern(df, "d") == pattern


def test_q5_ambiguous_is_month_first_and_mixed_fails(spark):
    df = spark.createDataFrame([("01/02/2025",)], "d string")
    assert parse_date_column(df, "d").first().d.isoformat() == "2025-01-02"
    mixed = spark.createDataFrame([("2025-01-02",), ("01/02/2025",)], "d string")
    with pytest.raises(ValueError):
        detect_date_pattern(mixed, "d")
    with pytest.raises(Exception, match="no known date format fits every value of column 'd'"):
        parse_date_column(mixed, "d").collect()


def test_q6_inclusive_overlap_and_null_dates(spark):
    df = frame(spark, [("2025-01-07", "x", 1.0, 0.0), ("2025-01-08", "x", 10.0, 0.0), (None, "x", 100.0, 0.0)])
    r = run(spark, df, ["k"], ["a"], ["a"], cur=("2025-01-07", "2025-01-14"), prev=("2025-01-01", "2025-01-07"))
    row = r.insights.first()
    assert (row.current_value, row.previous_value) == (11.0, 1.0)


def test_q7_bounds_checked():
    with pytest.raises(ValueError):
        report_config([], ["a"], ["a"], cur=("2025-1-08x", "2025-01-14"))


def test_q8_metric_list_dedup():
    cfg = report_config([], ["r", "a", "z"], ["a", "b"], {"r": "a / b"})
    assert metric_list(cfg) == ["a", "b", "r", "z"]


def test_q9_dims_and_metrics_checked(spark):
    df = frame(spark, [("2025-01-09", "x", 1.0, 2.0)])
    with pytest.raises(ValueError, match="nope"):
        aggregate_by_dimensions(df, ["nope"], ["a"])
    with pytest.raises(ValueError, match="none of the metrics"):
        aggregate_by_dimensions(df, ["k"], ["nope"])
    assert aggregate_by_dimensions(df, [], ["a", "nope"]).columns == ["a"]


def test_q10_q11_one_sided_groups(spark):
    df = frame(spark, [("2025-01-09", "cur_only", 5.0, 0.0), ("2025-01-02", "prev_only", 3.0, 0.0)])
    got = by_key(run(spark, df, ["k"], ["a"], ["a"]).insights.collect(), "k")
    assert (got[("cur_only",)].previous_value, got[("cur_only",)].delta_pct) == (0.0, 100.0)
    assert (got[("prev_only",)].current_value, got[("prev_only",)].delta_pct) == (0.0, -100.0)


def test_q12_null_dimension(spark):
    df = frame(spark, [("2025-01-09", None, 5.0, 0.0), ("2025-01-02", None, 3.0, 0.0)])
    fused = run(spark, df, ["k"], ["a"], ["a"]).insights.collect()
    assert len(fused) == 1 and fused[0].delta == 2.0
    cfg = report_config(["k"], ["a"], ["a"])
    cur = aggregate_by_dimensions(df.where("d >= '2025-01-08'"), ["k"], ["a"])
    prev = aggregate_by_dimensions(df.where("d < '2025-01-08'"), ["k"], ["a"])
    assert join_periods(cur, prev, list(cfg.report.primary_dims)).count() == 2


@pytest.mark.parametrize("cur,prev,pct", [(5.0, 0.0, 100.0), (-5.0, 0.0, -100.0), (0.0, 0.0, 0.0),
                                          (5.0, -10.0, 150.0), (1.0, 3.0, -66.67)])
def test_q13_delta_pct(spark, cur, prev, pct):
    df = frame(spark, [("2025-01-09", "x", cur, 0.0), ("2025-01-02", "x", prev, 0.0)])
    assert run(spark, df, ["k"], ["a"], ["a"]).insights.first().delta_pct == pct


def test_q14_impact_uses_unrounded_inputs_and_priority(spark):
    df = frame(spark, [("2025-01-09", "x", 3.0, 10.0), ("2025-01-02", "x", 1.0, 4.0)])
    got = by_key(run(spark, df, ["k"], ["a", "b"], ["a", "b"]).insights.collect(), "metric")
    # a: |2| * (1 + 200/200) * (1 + 2/2) ; b: |6| * (1 + 150/200) * (1 + 1/2)
    assert got[("a",)].impact_score == 8.0 and got[("b",)].impact_score == 15.75
    assert [r.metric for r in run(spark, df, ["k"], ["a", "b"], ["a", "b"]).insights.orderBy("rank").collect()] \
        == ["b", "a"]


def test_q16_direction(spark):
    df = frame(spark, [("2025-01-09", "up", 2.0, 0.0), ("2025-01-02", "up", 1.0, 0.0),
                       ("2025-01-09", "flat", 1.0, 0.0), ("2025-01-02", "flat", 1.0, 0.0),
                       ("2025-01-09", "down", 0.0, 0.0), ("2025-01-02", "down", 1.0, 0.0)])
    got = by_key(run(spark, df, ["k"], ["a"], ["a"]).insights.collect(), "k")
    assert {k[0]: r.direction for k, r in got.items()} == {"up": "up", "flat": "flat", "down": "down"}


def test_q17_absent_kpi_keeps_n(spark):
    df = frame(spark, [("2025-01-09", "x", 2.0, 0.0), ("2025-01-02", "x", 1.0, 0.0)])
    rows = run(spark, df, ["k"], ["missing", "a"], ["a"]).insights.collect()
    assert [r.metric for r in rows] == ["a"]
    assert rows[0].kpi_index == 1 and rows[0].impact_score == 1.0 * 1.5 * 1.5  # |d| * (1 + 100/200) * (1 + (2 - 1)/2)


def test_q18_nan_min_impact_and_limit(spark):
    df = frame(spark, [("2025-01-09", "nan", float("nan"), 0.0), ("2025-01-02", "nan", 1.0, 0.0),
                       ("2025-01-09", "big", 100.0, 0.0), ("2025-01-02", "big", 1.0, 0.0),
                       ("2025-01-09", "small", 2.0, 0.0), ("2025-01-02", "small", 1.0, 0.0)])
    r = run(spark, df, ["k"], ["a"], ["a"], min_impact=3.5).insights.collect()
    assert [x.k for x in r] == ["big"]
    r = run(spark, df, ["k"], ["a"], ["a"], top_n=1).insights.collect()
    assert [x.k for x in r] == ["big"]
    r = run(spark, df, ["k"], ["a"], ["a"], top_n=None).insights.orderBy("rank").collect()
    assert [x.k for x in r] == ["big", "small"] and not any(math.isnan(x.impact_score) for x in r)


def test_q19_q20_summary(spark):
    df = frame(spark, [("2025-01-09", "g1", 2.0, 0.0), ("2025-01-02", "g1", 1.0, 0.0),
                       ("2025-01-09", "g2", 20.0, 0.0), ("2025-01-02", "g2", 15.0, 0.0),
                       ("2025-01-09", "d1", 1.0, 0.0), ("2025-01-02", "d1", 4.0, 0.0)])
    s = run(spark, df, ["k"], ["a"], ["a"]).summary.first()
    assert (s.total_insights, s.total_gains, s.total_drops) == (3, 2, 1)
    assert s.top_mover.k == "g2" and s.biggest_gain.k == "g1" and s.biggest_drop.k == "d1"
    empty = frame(spark, [("2024-01-01", "g1", 2.0, 0.0)])
    e = run(spark, empty, ["k"], ["a"], ["a"]).summary.collect()
    assert len(e) == 1 and e[0].total_insights == 0 and e[0].top_mover is None
    n = run(spark, empty, ["k"], ["a"], ["a"]).narrative.first()
    assert n.bullets == ["Additional analysis pending."] * 3
    assert n.headline.startswith("Performance metrics remained stable")


def _two_source_config(join_key=None):
    from kpishift import config_from_dict
    sec = {"type": "table", "table": "s", "date_col": "d"}
    if join_key:
        sec["join_key"] = join_key
    return config_from_dict({
        "dataset": {"primary_source": "p", "sources": {"p": {"type": "table", "table": "p", "date_col": "d"},
                                                       "s": sec}},
        "report": {"primary_date_col": "d", "primary_dims": ["k"],
                   "comparison": {"current_start": "2025-01-08", "current_end": "2025-01-14",
                                  "previous_start": "2025-01-01", "previous_end": "2025-01-07"}}})


def test_q21_to_q24_join_rules(spark):
    p = spark.createDataFrame([("2025-01-09", "x", 1.0), ("2025-01-09", "y", 2.0)], "d string, k string, a double")
    s = spark.createDataFrame([("2025-01-09", "x", 10.0, 7.0), ("2025-01-09", "x", 20.0, 8.0)],
                              "d string, k string, r double, a double")
    out = join_sources({"p": p, "s": s}, _two_source_config())
    assert out.columns == ["d", "k", "a", "r"]               # colliding 'a' kept from the primary
    assert out.count() == 3                                   # duplicate right keys multiply x
    lone = spark.createDataFrame([(1,)], "z int")
    assert join_sources({"p": p, "s": lone}, _two_source_config()).count() == 2  # no common key: skipped
    only_k = join_sources({"p": p, "s": s}, _two_source_config(join_key=["k"]))
    assert only_k.where("k = 'x'").count() == 2


def test_q25_date_fallback(spark):
    from kpishift import config_from_dict, run_report
    df = spark.createDataFrame([("01/09/2025", "x", 2.0), ("01/02/2025", "x", 1.0)], "order_date string, k string, a double")
    cfg = config_from_dict({
        "dataset": {"primary_source": "f", "sources": {"f": {"type": "table", "table": "f", "date_col": "day",
                                                             "metrics": ["a"]}}},
        "report": {"primary_date_col": "day", "primary_dims": ["k"], "kpi_priority": ["a"],
                   "comparison": {"current_start": "2025-01-08", "current_end": "2025-01-14",
                                  "previous_start": "2025-01-01", "previous_end": "2025-01-07"}}})
    r = run_report(spark, cfg, frames={"f": df}).insights.first()
    assert (r.current_value, r.previous_value) == (2.0, 1.0)
    with pytest.raises(ValueError):
        run_report(spark, cfg, frames={"f": df.withColumnRenamed("order_date", "when")})


def test_q27_text_and_date_keys_join_as_dates(spark):
    from kpishift.sources.ingest import ingest_data
    p = spark.createDataFrame([("01/09/2025", "x", 1.0)], "d string, k string, a double")
    s = spark.createDataFrame([("2025-01-09", "x", 5.0)], "d string, k string, r double").select(
        F.to_date("d").alias("d"), "k", "r")
    cfg = _two_source_config()
    joined, _ = ingest_data(spark, cfg, frames={"p": p, "s": s})
    assert joined.first().r == 5.0


def test_literal_and_fused_agree(spark):
    import random
    rnd = random.Random(7)
    rows = [(f"2025-01-{rnd.randint(1, 16):02d}", f"k{rnd.randint(0, 9)}", float(rnd.randint(-50, 50)),
             float(rnd.randint(0, 9))) for _ in range(400)]
    df = frame(spark, rows)
    kw = dict(cur=("2025-01-06", "2025-01-12"), prev=("2025-01-01", "2025-01-07"), top_n=None)
    a = run(spark, df, ["k"], ["a", "r"], ["a", "b"], {"r": "a / b"}, plan="fused", **kw)
    b = run(spark, df, ["k"], ["a", "r"], ["a", "b"], {"r": "a / b"}, plan="literal", **kw)
    key = lambda r: (r.k, r.metric)
    fa = sorted(a.insights.collect(), key=key)
    fb = sorted(b.insights.collect(), key=key)
    assert [tuple(r) for r in fa] == [tuple(r) for r in fb]
    cfg = report_config(["k"], ["a"], ["a"], **{k: v for k, v in kw.items() if k != "top_n"})
    assert period_aggregate(df.withColumn("d", F.to_date("d")), cfg, "d").count() == 10


def test_q16_decimal_accumulator_keeps_flat_rows_flat(spark):
    df = frame(spark, [("2025-01-09", "x", 0.1, 0.0), ("2025-01-10", "x", 0.2, 0.0), ("2025-01-02", "x", 0.3, 0.0)])
    dbl = run(spark, df, ["k"], ["a"], ["a"]).insights.first()
    dec = run(spark, df, ["k"], ["a"], ["a"], accumulator="decimal").insights.first()
    assert dbl.direction == "up"          # 0.1 + 0.2 > 0.3 in binary floating point
    assert dec.direction == "flat" and dec.impact_score == 0.0


def test_column_names_with_dots_and_spaces(spark):
    from kpishift import config_from_dict, run_report
    df = spark.createDataFrame([("2025-01-09", "x", 2.0, 4.0), ("2025-01-02", "x", 1.0, 1.0),
                                ("2025-01-09", "y", 5.0, 1.0)],
                               "`order date` string, `geo.code` string, `spend usd` double, `clicks.n` double")
    cfg = config_from_dict({
        "dataset": {"primary_source": "f", "sources": {"f": {"type": "table", "table": "f", "date_col": "order date",
                                                             "metrics": ["spend usd", "clicks.n"]}}},
        "report": {"primary_date_col": "order date", "primary_dims": ["geo.code"],
                   "kpi_priority": ["spend usd", "clicks.n"], "report_key": [],
                   "comparison": {"current_start": "2025-01-08", "current_end": "2025-01-14",
                                  "previous_start": "2025-01-01", "previous_end": "2025-01-07"}}})
    rep = run_report(spark, cfg, frames={"f": df})
    rows = {(r["geo.code"], r.metric): r for r in rep.insights.collect()}
    assert rows[("x", "spend usd")].delta == 1.0 and rows[("y", "clicks.n")].current_value == 1.0
    for t in (rep.summary, rep.totals, rep.breakdown, rep.cards, rep.table, rep.narrative):
        assert t.count() >= 1
    assert rep.table.orderBy("rank").first().segment.startswith("geo.code: ")


@pytest.mark.parametrize("odd", [float("inf"), float("-inf"), float("nan")])
def test_decimal_accumulator_keeps_nonfinite_values(spark, odd):
    import math

    df = frame(spark, [("2025-01-09", "x", odd, 0.0), ("2025-01-10", "x", 0.2, 0.0), ("2025-01-02", "x", 0.3, 0.0),
                       ("2025-01-09", "y", 1.5, 0.0), ("2025-01-02", "y", 1.0, 0.0)])
    sums = {}
    for kind in ("double", "decimal"):
        rep = run(spark, df, ["k"], ["a"], ["a"], accumulator=kind)
        sums[kind] = {r.k: (r.a_current, r.a_previous) for r in rep.periods.collect()}
        rows = {r.k: (r.current_value, r.previous_value, r.direction) for r in rep.insights.collect()}
        assert rows["y"] == (1.5, 1.0, "up") and ("x" in rows) == (not math.isnan(odd))
    for k, want in sums["double"].items():
        assert all(a == b or (math.isnan(a) and math.isnan(b)) for a, b in zip(sums["decimal"][k], want))


@pytest.mark.parametrize("rows", [[("2025-01-09", "x", 1e29, 0.0)],
                                  [("2025-01-09", "x", 9e26, 0.0)] * 20])
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_decimal_accumulator_out_of_range_fails_clearly(spark, rows, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="accumulator decimal"):
            run(spark, frame(spark, rows), ["k"], ["a"], ["a"], accumulator="decimal").insights.collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_source_columns_named_like_flags_or_helpers(spark):
    names = ["in_current", "in_previous", "_c", "_p", "__p0", "_pid", "_first"]
    df = spark.createDataFrame([("2025-01-09", "x", 2.0, *[7.0] * len(names)), ("2025-01-02", "x", 1.0, *[7.0] * len(names))],
                               "d string, k string, a double, " + ", ".join(f"{n} double" for n in names))
    for n in names:
        for top_n in (5, None):
            rows = run(spark, df, ["k", n], ["a", "in_current"], ["a", "in_current"] if n != "in_current" else ["a"], top_n=top_n)
            assert {r.metric: r.delta for r in rows.insights.collect()}["a"] == 1.0


def test_full_ranking_runs_nothing_until_used(spark, monkeypatch):
    import kpishift.operators.rank as rank
    import kpishift.plans.report as report

    cuts = []
    for m in (rank, report):
        monkeypatch.setattr(m, "cut_lineage", lambda df, cut=m.cut_lineage: cuts.append(1) or cut(df))
    df = frame(spark, [(f"2025-01-{1 + i % 14:02d}", f"k{i}", float(i), 1.0) for i in range(50)])
    rep = run(spark, df, ["k"], ["a"], ["a"], top_n=None)
    assert not cuts
    assert rep.insights.schema["rank"].dataType.simpleString() == "bigint"
    assert sorted(r.rank for r in rep.insights.collect()) == list(range(1, 51)) and len(cuts) == 1
    from kpishift import write_report
    from kpishift.session import remove_scratch, scratch_path

    cuts.clear()
    path = scratch_path(spark, "full-ranking-once")
    write_report(run(spark, df, ["k"], ["a"], ["a"], top_n=None), path, extra=("totals", "breakdown"))
    assert len(cuts) == 2  # the period aggregate, and the ranking where it is numbered
    assert spark.read.parquet(f"{path}/insights").count() == 50
    remove_scratch(spark, path)


def test_scratch_folder_rules(spark, monkeypatch):
    import kpishift.session as session

    class Conf:
        def __init__(self, master):
            self.master = master

        def get(self, key, default=None):
            return self.master if key == "spark.master" else default

    class Session:
        def __init__(self, master):
            self.conf = Conf(master)

    monkeypatch.setattr(session, "_context", lambda s: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session("spark://host:7077"))
    assert session.checkpoint_dir(Session("local[4]"))
    monkeypatch.undo()
    with pytest.raises(ValueError):
        session.remove_scratch(spark, "/somewhere/else")


def test_profile_rules(spark):
    from kpishift import column_profile, suggested_ranges

    n = 1000
    df = spark.createDataFrame([(i % 3, i % 2, i, i % 5, None if i % 4 else 1.5, f"{1 + i % 12:02d}/{1 + i % 28:02d}/2024")
                                for i in range(n)], "grade int, store int, visits int, item_count int, price double, `sold on` string")
    p = {r.column_name: r for r in column_profile(df).collect()}
    assert {k: r.role for k, r in p.items()} == {"grade": "dimension", "store": "dimension", "visits": "metric",
                                                "item_count": "metric", "price": "metric", "sold on": "date"}
    assert p["grade"].distinct_estimate == 3 and p["store"].distinct_estimate == 2
    assert abs(p["visits"].distinct_estimate - n) <= 0.15 * n
    assert p["price"].null_rate == 0.75 and p["grade"].null_rate == 0.0
    r = suggested_ranges(df, "sold on").first()
    assert (r.anchor, r.current_start, r.previous_start, r.previous_end) == ("2024-12-28", "2024-12-21", "2024-12-14", "2024-12-20")
    assert column_profile(df.limit(0)).where("null_rate <> 0").count() == 0
