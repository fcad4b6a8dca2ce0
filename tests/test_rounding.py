"""Rounding equals Python's round(x, d) bit for bit, on Spark and (by its own means) in the DuckDB statements."""

import math
import random

import duckdb
from pyspark.sql import functions as F

from kpishift.functions.numeric import exact_round_sql, round_columns, round_to
from kpishift.plans.oracle import rnd

TIES = [2.675, -5.55, 12.35, 8.25, 0.045, 0.025, -0.004, 0.5, 1.5, 2.5, -2.5, 0.125, -0.375, 1e15, -0.0, 0.0,
        float("nan")]


def _values():
    rnd = random.Random(5)  # noqa: F811
    vals = list(TIES)
    vals += [rnd.randint(-10**6, 10**6) / 10**rnd.randint(0, 5) for _ in range(3000)]
    vals += [rnd.uniform(-1e7, 1e7) for _ in range(2000)]
    vals += [rnd.randint(-10**5, 10**5) + 0.5 for _ in range(300)]
    # from 2^52 / 10^digits on the product has no fraction left, but the value has
    vals += [rnd.choice([-1, 1]) * 10 ** rnd.uniform(11, 16) for _ in range(6000)]
    vals += [rnd.choice([-1, 1]) * (rnd.randrange(2**30, 2**44) + k / 16) for k in range(16) for _ in range(40)]
    vals += [532421441439.73193, -532421441439.73193, 2.0**52, 2.0**52 - 0.5, -(2.0**52) + 0.5, float("inf")]
    return vals


def _same(a, b):
    if math.isnan(b):
        return math.isnan(a)
    if math.isinf(b):
        return a == b
    return a == b and math.copysign(1, a) == math.copysign(1, b)


def test_spark_and_duckdb_round_like_python(spark):
    vals = _values()
    digits = [0, 1, 2, 4]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x double")
    cols = [round_to(F.col("x"), d).alias(f"c{d}") for d in digits]
    cols += [F.expr(exact_round_sql("x", d)).alias(f"s{d}") for d in digits]
    staged = round_columns(df, [("x", d, f"r{d}") for d in digits], ["i"])
    rows = df.select("i", "x", *cols).join(staged, "i").orderBy("i").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i INTEGER, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(vals)))
    duck = con.execute("SELECT " + ", ".join(rnd("x", d) for d in digits)
                       + " FROM t ORDER BY i").fetchall()
    for r, dk in zip(rows, duck):
        for j, d in enumerate(digits):
            want = round(r.x, d) if math.isfinite(r.x) else r.x
            assert _same(r[f"c{d}"], want), (r.x, d)
            assert _same(r[f"s{d}"], want), (r.x, d)
            assert _same(r[f"r{d}"], want), (r.x, d)
            assert _same(dk[j], want), (r.x, d)
