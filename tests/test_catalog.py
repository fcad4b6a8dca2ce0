"""Every registered query against its DuckDB statement (sf0.001) and the entry smoke check."""

import math
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from kpishift.plans import catalog

from .conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels", "documents"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(recs, cols):
    return sorted((tuple(_norm(r[c]) for c in cols) for r in recs), key=repr)


CORE = sorted(catalog.QUERIES)  # the training-data queries have tests of their own


def test_every_query_has_an_oracle():
    assert set(CORE) == set(catalog.oracle_statements()) and set(CORE) <= set(queries())


@pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="test data missing")
@pytest.mark.parametrize("name", CORE)
def test_query_matches_oracle(spark, duck, name):
    sdf = queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    srows = [r.asDict(recursive=True) for r in sdf.collect()]
    cur = duck.execute(oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = [dict(zip(dcols, r)) for r in cur.fetchall()]
    assert cols == sorted(dcols)
    assert _rows(srows, cols) == _rows(drows, cols)


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() > 0
    assert "impact_score" in df.columns and "rank" in df.columns
