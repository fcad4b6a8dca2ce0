import os
import random
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpishift.operators.profile import column_profile
from kpishift.session import scratch_path
from kpishift.sources.kept_profile import PROBABILITIES, KeptProfile

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("order.id", T.LongType()), ("day", T.StringType()), ("x", T.DoubleType()), ("flag", T.BooleanType()), ("tag", T.StringType()),
    ("price", T.DecimalType(10, 2)), ("parts", T.ArrayType(T.IntegerType())))])


def rows(seed, n):
    r = random.Random(seed)
    return [(r.randrange(5000), r.choice([None, f"2025-01-{r.randrange(1, 29):02d}"]), r.choice([None, float("nan"), r.gauss(0, 100)]),
             r.choice([True, False, None]), r.choice(["", "a", "b", None]), None, [r.randrange(3)]) for _ in range(n)]


@pytest.fixture
def folder(spark):
    return scratch_path(spark, f"kept-profile-test-{uuid.uuid4().hex}")


def write(spark, folder, name, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/in/{name}")


def kept_and_reads(spark, folder):
    seen = []

    def read(files):
        seen.append(sorted(os.path.basename(os.path.dirname(f)) for f in files))
        return spark.read.schema(SCHEMA).parquet(*files)

    return KeptProfile(spark, f"{folder}/kept", SCHEMA, read), seen


def test_old_and_new_files_read_only_new_ones(spark, folder):
    parts = {"a": rows(1, 3000), "b": rows(2, 2000), "c": rows(3, 1000)}
    kept, seen = kept_and_reads(spark, folder)
    for name in "ab":
        write(spark, folder, name, parts[name])
    assert kept.refresh(f"{folder}/in") == {"new": 2, "changed": 0, "gone": 0}
    write(spark, folder, "c", parts["c"])
    assert kept.refresh(f"{folder}/in")["new"] == 1
    assert kept.refresh(f"{folder}/in") == {"new": 0, "changed": 0, "gone": 0}
    assert seen == [["a", "b"], ["c"]]
    everything = [row for part in parts.values() for row in part]
    check(spark, kept, everything)
    write(spark, folder, "b", rows(4, 500))  # one file replaced
    counts = kept.refresh(f"{folder}/in")
    assert counts["new"] + counts["changed"] == 1 and len(seen) == 3 and seen[-1] == ["b"]
    check(spark, kept, parts["a"] + parts["c"] + rows(4, 500))


def check(spark, kept, data):
    df = spark.createDataFrame(data, SCHEMA)
    want = {r.column_name: r for r in column_profile(df).collect()}
    got = {r.column_name: r for r in kept.profile().collect()}
    assert set(got) == set(want)
    for name, w in want.items():
        g = got[name]
        for c in ("ordinal", "data_type", "row_count", "non_null_count", "null_count", "null_rate", "date_like_count", "role"):
            assert g[c] == w[c], (name, c)
        values = [r[w.ordinal] for r in data if r[w.ordinal] is not None]
        exact = len({str(v) for v in values})
        assert abs(g.distinct_estimate - exact) <= 0.04 * exact, name  # five standard deviations
    for name, place in (("order.id", 0), ("x", 2)):
        values = sorted(r[place] for r in data if r[place] is not None and r[place] == r[place])
        for p, v in zip(PROBABILITIES, got[name].quantiles):
            below, upto = sum(x < v for x in values) / len(values), sum(x <= v for x in values) / len(values)
            assert below - 0.01 <= p <= upto + 0.01, (name, p)
        assert (got[name].quantiles[0], got[name].quantiles[-1]) == (values[0], values[-1])
    assert got["price"].quantiles is None and got["tag"].quantiles is None


def test_files_without_rows(spark, folder):
    kept, _ = kept_and_reads(spark, folder)
    write(spark, folder, "a", [])
    kept.refresh(f"{folder}/in")
    assert kept.profile().collect() == []
    write(spark, folder, "b", rows(5, 200))
    kept.refresh(f"{folder}/in")
    check(spark, kept, rows(5, 200))


def test_columns_a_file_lacks_are_null(spark, folder):
    kept, _ = kept_and_reads(spark, folder)
    data = rows(6, 300)
    spark.createDataFrame(data, SCHEMA).drop("x").coalesce(1).write.parquet(f"{folder}/in/a")
    kept.refresh(f"{folder}/in")
    got = {r.column_name: r for r in kept.profile().collect()}
    assert got["x"].null_count == 300 and got["x"].quantiles is None and got["x"].role == "metric"
    assert got["order.id"].non_null_count == len([r for r in data if r[0] is not None])
