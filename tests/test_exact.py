import math
import random

import pytest
from pyspark.sql import functions as F

from kpishift.operators.aggregate import aggregate_by_dimensions, aggregate_periods

from .helpers import run


def fsum(values):
    try:
        return math.fsum(values)
    except OverflowError:  # fsum gives up where a sum between overflows
        total = sum(int(v) for v in values)
        if abs(total) >= 2 ** 1024 - 2 ** 970:
            return math.inf if total > 0 else -math.inf
        return float(total)


def groups():
    r = random.Random(4)
    out = {}
    for g in range(60):
        low, high = sorted((r.randrange(-1074, 1020), r.randrange(-1074, 1020)))
        out[g] = [r.choice([-1, 1]) * r.random() * 2.0 ** r.randrange(low, high + 1) for _ in range(r.randrange(1, 40))]
    for g in range(60, 90):  # everything but the last digits cancels
        x = [r.uniform(-1, 1) * 10.0 ** r.randrange(-20, 20) for _ in range(20)]
        out[g] = x + [-v for v in x] + [r.uniform(-1, 1) * 10.0 ** r.randrange(-30, 0) for _ in range(3)]
    out[100] = [1e308, 1e308, -1e308]
    out[101] = [1.7e308] * 3
    out[102] = [-1.7e308] * 3
    out[103] = [5e-324] * 7 + [-5e-324]
    out[104] = [0.0, -0.0]
    out[105] = [2.0 ** 53, 1.0, 2.0 ** -1074]       # just above a tie
    out[106] = [2.0 ** 53, 1.0]                      # a tie: to even
    out[107] = [2.0 ** 53, 1.0, -(2.0 ** -1074)]     # just below
    out[108] = [2.0 ** k for k in range(-1074, 1000, 7)]
    out[109] = [0.1] * 1000
    out[110] = [2.2250738585072014e-308, -5e-324]
    out[111] = [-(2.0 ** 20), 2.0 ** 20 - 2.0 ** -33]
    return out


def test_equals_fsum_on_all_magnitudes_in_any_order(spark):
    data = groups()
    rows = [(g, v) for g, values in data.items() for v in values] + [(104, None), (112, None)]
    want = {g: fsum(v) for g, v in data.items()} | {112: 0.0}
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "g int, x double").repartition(3 * seed)
        got = {r.g: r.x for r in aggregate_by_dimensions(df, ["g"], ["x"], "exact").collect()}
        assert got == want


def test_periods_odd_values_and_other_types(spark):
    rows = [("a", True, False, 0.1, 1, "1.10"), ("a", True, True, 0.2, 2, "2.20"), ("a", False, True, 0.3, None, None),
            ("b", True, False, math.inf, 5, "1"), ("b", False, True, math.nan, 5, "1"), ("c", True, False, math.inf, 1, "1"),
            ("c", True, False, -math.inf, 1, "1"), (None, False, True, None, None, None)]
    df = spark.createDataFrame(rows, "k string, in_c boolean, in_p boolean, `x.y` double, n int, t string")
    df = df.withColumn("d", F.col("t").cast("decimal(10,2)")).withColumn("f", F.col("`x.y`").cast("float"))
    metrics = ["n", "x.y", "d", "f"]
    plain = aggregate_periods(df, ["k"], metrics, "in_c", "in_p")
    exact = aggregate_periods(df, ["k"], metrics, "in_c", "in_p", "exact")
    assert exact.columns == plain.columns
    assert [f.dataType for f in exact.schema.fields] == [f.dataType for f in plain.schema.fields]
    got = {r.k: [str(v) for v in r] for r in exact.collect()}
    want = {r.k: [str(v) for v in r] for r in plain.collect()}
    want["a"][3], want["a"][4] = str(math.fsum([0.1, 0.2])), str(math.fsum([0.2, 0.3]))
    for k in want:
        assert got[k] == want[k], k


def test_no_dimensions_no_rows_and_a_whole_report(spark):
    df = spark.createDataFrame([(0.1,)] * 10, "x double")
    assert aggregate_by_dimensions(df, [], ["x"], "exact").first().x == 1.0
    assert aggregate_by_dimensions(df.limit(0), [], ["x"], "exact").first().x == 0.0
    assert aggregate_by_dimensions(df.withColumn("k", F.lit(1)).limit(0), ["k"], ["x"], "exact").count() == 0
    facts = spark.createDataFrame([(f"2025-01-{d:02d}", k, 1e16 if d == 9 else -1e16 if d == 10 else 0.5) for d in range(1, 15) for k in "ab"],
                                  "d string, k string, a double")
    rows = run(spark, facts, ["k"], ["a"], ["a"], accumulator="exact").insights.collect()
    assert {(r.k, r.current_value, r.previous_value) for r in rows} == {("a", 2.5, 3.5), ("b", 2.5, 3.5)}


@pytest.mark.parametrize("plan", ["fused", "literal"])
def test_both_plans(spark, plan):
    facts = spark.createDataFrame([("2025-01-09", "a", 0.1)] * 10 + [("2025-01-02", "a", 0.7)] * 3, "d string, k string, a double")
    r = run(spark, facts, ["k"], ["a"], ["a"], plan=plan, accumulator="exact").insights.first()
    assert (r.current_value, r.previous_value) == (1.0, round(math.fsum([0.7] * 3), 4))
