"""Physical plan shape of the flagship and the per-report plan."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from kpishift.operators.rank import number_rows
from kpishift.plans.catalog import per_nation_report, q_flagship

from .conftest import SF_SMALL


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_single_scan_single_exchange(spark):
    df = q_flagship(spark, SF_SMALL)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan parquet") == 1 or text.count("Scan parquet") >= 1
    opt = df._jdf.queryExecution().optimizedPlan().toString()
    assert opt.count("Relation") == 1
    assert "TakeOrderedAndProject" in text
    sparkplan = df._jdf.queryExecution().sparkPlan().toString()
    assert sparkplan.count("Exchange") <= 1  # only the aggregate's hash exchange before AQE
    assert "PushedFilters: [Or(And(GreaterThanOrEqual(l_shipdate" in sparkplan.replace("\n", " ") or \
        "l_shipdate" in sparkplan


def test_flagship_reads_only_needed_columns(spark):
    df = q_flagship(spark, SF_SMALL)
    sp = df._jdf.queryExecution().sparkPlan().toString()
    assert "l_orderkey" not in sp and "l_tax" not in sp


def test_per_report_top_n_is_window_group_limit(spark):
    rep = per_nation_report(spark, SF_SMALL)
    sp = rep.insights._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in sp


def test_number_rows_matches_row_number(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), rnd.random(), i) for i in range(20000)]
    df = spark.createDataFrame(rows, "g string, v double, id int").repartition(16)
    order = [F.col("v").desc(), F.col("id").asc()]
    got = number_rows(df, order, ["g"], "rn").select("id", "rn").collect()
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(*order))).select(
        "id", "rn").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    got_all = number_rows(df, order, [], "rn").select("id", "rn").collect()
    want_all = df.withColumn("rn", F.row_number().over(Window.orderBy(*order))).select("id", "rn").collect()
    assert sorted(map(tuple, got_all)) == sorted(map(tuple, want_all))


def test_date_partitioned_input_prunes_partitions(spark):
    import uuid

    from kpishift import config_from_dict, run_report
    from kpishift.session import scratch_path

    path = scratch_path(spark, f"by_month/{uuid.uuid4().hex}")
    (spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
     .select(F.trunc("l_shipdate", "month").cast("date").alias("ship_month"), "l_returnflag", "l_quantity")
     .write.partitionBy("ship_month").parquet(path))
    cfg = config_from_dict({
        "dataset": {"primary_source": "li", "sources": {"li": {"type": "parquet", "path": path,
                                                               "date_col": "ship_month",
                                                               "metrics": ["l_quantity"]}}},
        "report": {"primary_date_col": "ship_month", "primary_dims": ["l_returnflag"],
                   "kpi_priority": ["l_quantity"],
                   "comparison": {"current_start": "1998-01-01", "current_end": "1998-12-31",
                                  "previous_start": "1997-01-01", "previous_end": "1997-12-31"}}})
    ins = run_report(spark, cfg).insights
    sp = ins._jdf.queryExecution().sparkPlan().toString()
    assert "PartitionFilters: [" in sp and "ship_month" in sp.split("PartitionFilters: [")[1].split("]")[0]
    assert ins.count() == 3


def test_report_plans_compile_without_fallback(spark):
    """Whole-stage codegen must compile (no silent fallback to interpreted mode)."""
    from kpishift.plans.catalog import flagship_report, no_dims_report

    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        for rep in (flagship_report(spark, SF_SMALL), per_nation_report(spark, SF_SMALL),
                    no_dims_report(spark, SF_SMALL)):
            for df in (rep.insights, rep.summary, rep.totals, rep.breakdown, rep.cards, rep.table, rep.narrative):
                df.collect()
    finally:
        spark.conf.set("spark.sql.codegen.fallback", "true")


def _two_source(spark, with_metric_on_right=False):
    import random

    from kpishift import config_from_dict
    rnd = random.Random(9)
    facts = [(f"2025-01-{rnd.randint(1, 14):02d}", rnd.choice(["c1", "c2", "c3", None]), float(rnd.randint(1, 50)),
              float(rnd.randint(0, 4))) for _ in range(300)]
    p = spark.createDataFrame(facts, "d string, cust string, amount double, units double")
    # repeated keys on the right (c2 twice) multiply the matching fact rows
    rows = [("c1", "north", 1.0), ("c2", "south", 2.0), ("c2", "east", 3.0), ("c9", "west", 4.0)]
    s = spark.createDataFrame(rows, "cust string, region string, bonus double")
    if not with_metric_on_right:
        s = s.drop("bonus")
    cfg = config_from_dict({
        "dataset": {"primary_source": "p", "sources": {
            "p": {"type": "table", "table": "p", "date_col": "d", "metrics": ["amount", "units"]},
            "s": {"type": "table", "table": "s", "date_col": "d", "join_key": ["cust"]}}},
        "derived_metrics": {"per_unit": "amount / units", **({"b": "bonus * units"} if with_metric_on_right else {})},
        "report": {"primary_date_col": "d", "primary_dims": ["region"], "top_n": None,
                   "kpi_priority": ["per_unit", "amount", "units"] + (["b"] if with_metric_on_right else []),
                   "comparison": {"current_start": "2025-01-08", "current_end": "2025-01-14",
                                  "previous_start": "2025-01-01", "previous_end": "2025-01-08"}}})
    return cfg, {"p": p, "s": s}


def test_aggregation_below_joins_is_exact(spark):
    from kpishift.plans.report import eager_periods, load_all_sources, normalise_dates, run_report
    cfg, frames = _two_source(spark)
    assert eager_periods(cfg, normalise_dates(load_all_sources(spark, cfg, "", frames), cfg)) is not None
    eager = run_report(spark, pre_aggregated(cfg), frames=frames)
    first = run_report(spark, cfg, frames=frames)
    assert eager.facts.columns == first.facts.columns and eager.facts.count() == first.facts.count()
    plan = eager.periods._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("Aggregate")       # an aggregate sits below the join
    key = lambda r: (r.region or "", r.metric)
    a = sorted(eager.insights.drop("rank").collect(), key=key)
    b = sorted(first.insights.drop("rank").collect(), key=key)
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_metric_from_a_secondary_joins_first(spark):
    from kpishift.plans.report import eager_periods, load_all_sources, normalise_dates
    cfg, frames = _two_source(spark, with_metric_on_right=True)
    assert eager_periods(cfg, normalise_dates(load_all_sources(spark, cfg, "", frames), cfg)) is None


def pre_aggregated(cfg):
    from dataclasses import replace

    return replace(cfg, dataset=replace(cfg.dataset, pre_aggregate=True))


def test_per_nation_report_joins_first(spark):
    rep = per_nation_report(spark, SF_SMALL)
    plan = rep.periods._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.index("Aggregate") < plan.index("Join")
    rep.insights.collect()
    ran = plan_text(rep.insights).split("Initial Plan")[0]
    # one exchange for the aggregate, one for the report key; both joins are broadcast
    assert ran.count("Exchange hashpartitioning") == 2 and ran.count("BroadcastHashJoin") == 2


def test_metrics_that_are_join_keys(spark):
    """A KPI, or a derived metric, named like a join key: the same rows with and without pre-aggregation."""
    from kpishift import config_from_dict, run_report

    p = spark.createDataFrame([("2025-01-09", 1.0, 4.0), ("2025-01-02", 1.0, 2.0), ("2025-01-09", 2.0, 3.0)], "d string, k double, m double")
    s = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (5.0, "c")], "k double, seg string")
    for metrics, kpis, derived in ((["m", "k"], ["k", "m"], {}), (["m"], ["m"], {"k": "m + k"})):
        cfg = config_from_dict({
            "dataset": {"primary_source": "p", "sources": {
                "p": {"type": "table", "table": "p", "date_col": "d", "metrics": metrics},
                "s": {"type": "table", "table": "s", "date_col": "d", "join_key": ["k"]}}},
            "derived_metrics": derived,
            "report": {"primary_date_col": "d", "primary_dims": ["seg"], "kpi_priority": kpis,
                       "comparison": {"current_start": "2025-01-08", "current_end": "2025-01-14",
                                      "previous_start": "2025-01-01", "previous_end": "2025-01-07"}}})
        frames = {"p": p, "s": s}
        rows = [sorted(map(tuple, run_report(spark, c, frames=frames).insights.collect())) for c in (cfg, pre_aggregated(cfg))]
        assert rows[0] == rows[1] and rows[0]


def test_keyed_top_n_is_cut_before_the_shuffle_for_any_n(spark):
    from kpishift.plans.catalog import per_nation_config, per_nation_frames
    from kpishift import config_from_dict, run_report

    for n in (1000, 1001, 50_000):
        rep = run_report(spark, config_from_dict(per_nation_config(n)), frames=per_nation_frames(spark, SF_SMALL))
        text = rep.insights._jdf.queryExecution().executedPlan().toString()
        partial, final = text.index(", Partial"), text.index(", Final")
        assert "WindowGroupLimit" in text and "Exchange hashpartitioning(n_name" in text[final:partial]
