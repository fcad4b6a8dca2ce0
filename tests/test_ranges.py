import math
import os
import random
import uuid
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpishift import config_from_dict
from kpishift.operators.ranges import DAY, daily_sums, range_sums
from kpishift.plans.catalog import flagship_config, many_ranges, q_insights_many_ranges
from kpishift.plans.report import run_range_report, run_report
from kpishift.session import scratch_path
from kpishift.sources.kept import KeptDays

from .conftest import SF_SMALL
from .helpers import report_config

SCHEMA = "d date, k string, j int, x double, n int, t string"
RANGES = "range_id long, current_start date, current_end date, previous_start date, previous_end date"


def facts(seed, n=600):
    r = random.Random(seed)
    start = date(2025, 1, 1)
    rows = []
    for _ in range(n):
        x = r.choice([r.uniform(-100, 100)] * 30 + [None, math.nan, math.inf, -math.inf])
        rows.append((r.choice([start + timedelta(r.randrange(60))] * 20 + [None]), r.choice(["a", "b", None]), r.randrange(3), x,
                     r.choice([None, 1, 2, 1 << 30]), f"{r.randrange(1000) / 100}"))
    return rows


def some_ranges(seed, n=40):
    r = random.Random(seed)
    day = lambda: date(2024, 12, 20) + timedelta(r.randrange(90))
    out = []
    for i in range(n):
        bounds = [day() for _ in range(4)]
        if i % 4:
            bounds = sorted(bounds[:2]) + sorted(bounds[2:])
        out.append((i, *bounds))  # every fourth may end before it begins
    return [*out, (n, None, day(), day(), day()), (n + 1, date(2030, 1, 1), date(2030, 2, 1), date(2030, 1, 1), date(2030, 1, 1))]


def brute(rows, ranges):
    out = {}
    for i, cs, ce, ps, pe in ranges:
        if None in (cs, ce, ps, pe):
            continue
        for p, (a, b) in enumerate(((cs, ce), (ps, pe))):
            for d, k, j, x, n, t in rows:
                if d is not None and a <= d <= b:
                    sums = out.setdefault((i, k, j), [[[], [], []], [[], [], []]])
                    for m, v in enumerate((x, n, t)):
                        sums[p][m].append(v)
    def total(values, m):
        values = [v for v in values if v is not None]
        if m == 1:
            return sum(values)
        if m == 2:
            return f"{sum(round(float(v) * 100) for v in values) / 100:.2f}"
        odd = [v for v in values if not math.isfinite(v)]
        return str(sum(odd)) if odd else f"{math.fsum(values):.6f}"
    return {g: [total(s[p][m], m) for m in range(3) for p in (0, 1)] for g, s in out.items()}


@pytest.mark.parametrize("few", [True, False])
def test_against_brute_force(spark, few):
    rows, ranges = facts(1), some_ranges(2)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("t", F.col("t").cast("decimal(10,2)")).withColumnRenamed("x", "x.y").repartition(5)
    types = {"x.y": T.DoubleType(), "n": T.LongType(), "t": T.DecimalType(20, 2)}
    daily = daily_sums(df, "d", ["k", "j"], list(types))
    got = range_sums(daily, ["k", "j"], types, spark.createDataFrame(ranges, RANGES), few=few)
    assert [f.dataType.simpleString() for f in got.schema.fields[3:]] == ["double"] * 2 + ["bigint"] * 2 + ["decimal(20,2)"] * 2

    def shown(r):
        x = [str(v) if not math.isfinite(v) else f"{v:.6f}" for v in (r["x.y_current"], r["x.y_previous"])]
        return [*x, r.n_current, r.n_previous, str(r.t_current), str(r.t_previous)]

    want = brute(rows, ranges)
    zero = lambda v: "0.000000" if v == "-0.000000" else v
    assert {(r.range_id, r.k, r.j): list(map(zero, shown(r))) for r in got.collect()} == {k: list(map(zero, v)) for k, v in want.items()}
    assert len({k[0] for k in want}) > 20


def test_no_dimensions_empty_tables_and_bad_ranges(spark):
    df = spark.createDataFrame([(date(2025, 1, d), 1.5) for d in range(1, 11)], "d date, x double")
    cfg = report_config([], ["x"], ["x"])
    one = spark.createDataFrame([(7, date(2025, 1, 6), date(2025, 1, 10), date(2025, 1, 1), date(2025, 1, 4))], RANGES)
    r = run_range_report(spark, cfg, one, frames={"f": df}).insights.first()
    assert (r.range_id, r.current_value, r.previous_value) == (7, 7.5, 6.0)
    assert run_range_report(spark, cfg, one, frames={"f": df.limit(0)}).insights.count() == 0
    assert run_range_report(spark, cfg, one.limit(0), frames={"f": df}).insights.count() == 0
    with pytest.raises(ValueError, match="must be different"):
        run_range_report(spark, cfg, one.union(one), frames={"f": df})
    with pytest.raises(ValueError, match="names the range"):
        run_range_report(spark, cfg, one.withColumnRenamed("range_id", "x"), frames={"f": df}, key="x")


def test_one_range_equals_the_plain_report(spark):
    cfg = config_from_dict(flagship_config(SF_SMALL, accumulator="decimal"))
    cs, ce, ps, pe = cfg.report.comparison.bounds()
    got = run_range_report(spark, cfg, spark.createDataFrame([(1, cs, ce, ps, pe)], RANGES)).insights.drop("range_id")
    want = run_report(spark, cfg).insights
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_one_scan_with_pushed_bounds_and_one_shuffle_of_facts(spark):
    df = q_insights_many_ranges(spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "GreaterThanOrEqual(l_shipdate" in plan
    # daily partial sums, days by group, insights by range (two for the ranges' own small tables)
    assert plan.count("Exchange hashpartitioning(l_returnflag") == 2 and "Exchange hashpartitioning(mark" not in plan
    assert many_ranges(spark).count() == 1000


def sums_of(days):
    return {(r.k, str(r[DAY])): (r.x, r.n) for r in days.collect()}


def write(df, path):
    df.coalesce(1).write.mode("overwrite").parquet(path)


def test_kept_days_read_only_what_changed(spark):
    root = scratch_path(spark, f"kept-{uuid.uuid4().hex}")
    source, schema = f"{root}/source", "d string, k string, x double, n int"
    reads = []

    def read(files):
        reads.append(files)
        return spark.read.schema(schema).parquet(*files)

    def frame(*rows):
        return spark.createDataFrame(list(rows), schema)

    kept = KeptDays(spark, f"{root}/kept", read, "d", ["k"], {"x": T.DoubleType(), "n": T.LongType()}, date_format="yyyy-M-d")
    write(frame(("2025-01-01", "a", 1.0, 1), ("2025-01-02", "a", 2.0, None)), f"{source}/a b %1 [x]{{2,3}}*?+")  # a path that needs quoting
    write(frame(("2025-01-01", "a", 10.0, 1), (None, "a", 99.0, 9)), f"{source}/two")
    assert kept.refresh(source) == {"new": 2, "changed": 0, "gone": 0} and len(reads[0]) == 2
    assert {k: (float(x), int(n)) for k, (x, n) in sums_of(kept.days()).items()} == {("a", "2025-01-01"): (11.0, 2), ("a", "2025-01-02"): (2.0, 0)}
    assert kept.refresh(source) == {"new": 0, "changed": 0, "gone": 0} and len(reads) == 1

    write(frame(("2025-01-01", "b", 5.0, 5)), f"{source}/three")
    assert kept.refresh(source) == {"new": 1, "changed": 0, "gone": 0}
    assert len(reads[1]) == 1 and "/three/" in reads[1][0]
    scanned = kept.sums(reads[1]).inputFiles()
    assert len(scanned) == 1 and "/three/" in scanned[0]
    assert set(sums_of(kept.days())) == {("a", "2025-01-01"), ("a", "2025-01-02"), ("b", "2025-01-01")}
    assert set(sums_of(kept.days(version=1))) == {("a", "2025-01-01"), ("a", "2025-01-02")}

    write(frame(("2025-01-01", "a", 100.0, 1)), f"{source}/two")  # another file in its place
    assert kept.refresh(source) == {"new": 1, "changed": 0, "gone": 1}
    assert float(sums_of(kept.days())["a", "2025-01-01"][0]) == 101.0
    same = [f for f in kept.listing(source).select("path").collect() if "/two/" in f.path][0].path.replace("file:", "", 1)
    data = frame(("2025-01-01", "a", 1000.0, 1)).toPandas()
    data["n"] = data["n"].astype("int32")
    data.to_parquet(same)  # the same name, other contents
    folder, name = os.path.split(same)
    os.remove(f"{folder}/.{name}.crc")  # the local file system's checksum of the file before
    assert kept.refresh(source) == {"new": 0, "changed": 1, "gone": 0}
    assert float(sums_of(kept.days())["a", "2025-01-01"][0]) == 1001.0
    write(frame(("2025-01-01", "a", 0.0, 1)).limit(0), f"{source}/two")
    kept.refresh(source)
    assert float(sums_of(kept.days())["a", "2025-01-01"][0]) == 1.0
    kept.store.vacuum(keep=1)
    assert set(sums_of(kept.days())) == {("a", "2025-01-01"), ("a", "2025-01-02"), ("b", "2025-01-01")}
