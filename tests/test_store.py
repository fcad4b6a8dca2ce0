import uuid

import pytest
from pyspark.sql import functions as F

from kpishift.operators.periods import parse_date_column
from kpishift.operators.profile import column_profile, suggested_ranges
from kpishift.plans.catalog import per_nation_report
from kpishift.session import scratch_path
from kpishift.sources.sinks import write_report
from kpishift.sources.store import ReportStore

from .conftest import SF_SMALL
from .helpers import jobs_of


@pytest.fixture
def store(spark):
    return ReportStore(spark, scratch_path(spark, f"store-{uuid.uuid4().hex}"), ["k"])


def rows(spark, *pairs):
    return {"t": spark.createDataFrame(list(pairs), "k string, v int")}


def read(store, **options):
    return sorted((r.k or "", r.v) for r in store.read("t", **options).collect())


def test_a_run_replaces_its_own_reports_only(spark, store):
    assert store.version() == 0
    assert store.publish(rows(spark, ("a", 1), ("b", 2), (None, 3))) == 1
    assert store.publish(rows(spark, ("b", 20), ("b", 21))) == 2
    assert read(store) == [("", 3), ("a", 1), ("b", 20), ("b", 21)]
    assert read(store, version=1) == [("", 3), ("a", 1), ("b", 2)]  # a reader of an older version sees that one
    assert read(store, key={"k": None}) == [("", 3)] and read(store, key={"k": "b"}) == [("b", 20), ("b", 21)]
    # a covered report without rows is empty; the same rows again change nothing else
    assert store.publish(rows(spark), spark.createDataFrame([("a",), ("c",)], "k string")) == 3
    assert read(store) == [("", 3), ("b", 20), ("b", 21)]


def test_reader_sees_nothing_of_an_uncommitted_run(spark, store):
    store.publish(rows(spark, ("a", 1)))
    before = store.read("t")
    commit = store._create_commit
    seen = []

    def during(version, content):  # the data and the manifest are written, the commit is not
        seen.append(read(store))
        return commit(version, content)

    store._create_commit = during
    store.publish(rows(spark, ("a", 2), ("b", 2)))
    assert seen == [[("a", 1)]] and read(store) == [("a", 2), ("b", 2)]
    assert [r.v for r in before.collect()] == [1]


def test_two_writers_at_once_both_count(spark, store):
    store.publish(rows(spark, ("a", 1)))
    other = ReportStore(spark, store.root, ["k"])
    commit, tries = store._create_commit, []

    def late(version, content):
        tries.append(version)
        if len(tries) == 1:
            other.publish(rows(spark, ("b", 5), ("c", 5)))  # commits the version this run wanted
        return commit(version, content)

    store._create_commit = late
    assert store.publish(rows(spark, ("c", 9))) == 3 and tries == [2, 3]
    assert read(store) == [("a", 1), ("b", 5), ("c", 9)]


def test_vacuum_keeps_what_is_in_use(spark, store):
    for n in range(4):
        store.publish(rows(spark, ("a", n), ("only-first", 7)) if n == 0 else rows(spark, ("a", n)))
    runs = store._names("data")
    assert store.vacuum(keep=2) == {"versions": 2, "runs": 1}  # run 2; run 1 still holds a report, 3 and 4 are kept
    assert store.versions() == [3, 4] and set(store._names("data")) == {runs[0], *runs[2:]}
    assert read(store) == [("a", 3), ("only-first", 7)] and read(store, version=3) == [("a", 2), ("only-first", 7)]
    with pytest.raises(ValueError, match="no version 1"):
        store.read("t", version=1)
    assert store.vacuum(keep=5) == {"versions": 0, "runs": 0}


def test_a_run_older_than_the_oldest_version_fails(spark, store):
    store.publish(rows(spark, ("a", 0)))
    other = ReportStore(spark, store.root, ["k"])

    class Slow(ReportStore):
        def version(self):  # what it saw when it began
            return 1

    for n in range(3):
        other.publish(rows(spark, ("a", n)))
    other.vacuum(keep=1)
    with pytest.raises(RuntimeError, match="run it again"):
        Slow(spark, store.root, ["k"]).publish(rows(spark, ("z", 1)))
    assert read(store) == [("a", 2)]


def test_reports_with_other_columns_and_bad_tables(spark, store):
    store.publish(rows(spark, ("a", 1)))
    store.publish({"t": spark.createDataFrame([("b", 2, "x")], "k string, v int, w string")})
    assert sorted((r.k, r.v, r.w) for r in store.read("t").collect()) == [("a", 1, None), ("b", 2, "x")]
    with pytest.raises(ValueError, match="key columns"):
        store.publish({"t": spark.range(1)})
    with pytest.raises(ValueError, match="has a table"):
        store.read("absent")
    with pytest.raises(ValueError, match="key column"):
        ReportStore(spark, store.root, [])


def test_one_report_reads_its_run_with_a_pushed_filter(spark, store):
    store.publish(rows(spark, ("a", 1), ("b", 1)))
    store.publish(rows(spark, ("b", 2)))
    plan = store.read("t", key={"k": "b"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "EqualNullSafe(k,b)" in plan.replace("`", "") and store._names("data")[0] not in plan


def test_report_without_keys_is_named(spark):
    from kpishift.plans.catalog import flagship_report

    store = ReportStore(spark, scratch_path(spark, f"store-{uuid.uuid4().hex}"), ["report"])
    rep = flagship_report(spark, SF_SMALL)
    store.publish_report(rep, extra=("totals",), name="weekly")
    store.publish_report(rep, name="daily")
    assert {(r.report, r["count"]) for r in store.read("insights").groupBy("report").count().collect()} == {
        ("weekly", rep.insights.count()), ("daily", rep.insights.count())}
    assert {r.report for r in store.read("totals").collect()} == {"weekly"}
    assert [r.kpis[0] for r in store.read("meta", key={"report": "daily"}).collect()] == ["unit_price"]
    with pytest.raises(ValueError, match="needs a name"):
        store.publish_report(rep)


def test_plain_sink_leaves_other_keys(spark):
    path = scratch_path(spark, f"sink-{uuid.uuid4().hex}")
    rep = per_nation_report(spark, SF_SMALL)
    names = sorted(r.n_name for r in rep.insights.select("n_name").distinct().where("n_name is not null").collect())
    write_report(rep, path)
    rep.insights = rep.insights.where(F.col("n_name") == names[0]).withColumn("impact_score", F.lit(-1.0))
    rep.summary = rep.summary.where(F.col("n_name") == names[0])
    write_report(rep, path, materialize=False)
    back = spark.read.parquet(f"{path}/insights")
    assert sorted(r.n_name for r in back.select("n_name").distinct().where("n_name is not null").collect()) == names
    assert {r.n_name for r in back.where("impact_score = -1.0").collect()} == {names[0]}


def test_dates_are_detected_within_the_plan(spark):
    df = spark.createDataFrame([("13/02/2025", "12/31/2024"), ("01/02/2025", "31/12/2024"), (None, None)], "a string, sent_date string").cache()
    df.count()
    with jobs_of(spark) as jobs:
        parsed = parse_date_column(df, "a")
    assert jobs() == 0
    assert [str(r.a) for r in parsed.orderBy("a").collect()] == ["None", "2025-02-01", "2025-02-13"]
    assert {r.column_name: r.role for r in column_profile(df).collect()} == {"a": "date", "sent_date": "dimension"}
    assert suggested_ranges(df, "a").first().anchor == "2025-02-13"
    assert parse_date_column(df.where("a is null"), "a").count() == 1 and parse_date_column(df.limit(0), "a").count() == 0
