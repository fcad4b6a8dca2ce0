"""Named queries over the benchmark tables, each with a DuckDB statement.

Every query reads whole tables (or data Spark derives from them); nothing
is sampled or capped except where the limit is the feature (top-N).
"""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import config_from_dict
from ..operators.aggregate import aggregate_by_dimensions
from ..operators.derive import compute_all_derived_metrics
from ..operators.joins import join_periods, join_sources
from ..operators.periods import IN_CURRENT, IN_PREVIOUS, flag_periods, parse_date_column
from ..operators.profile import column_profile, suggested_ranges
from ..session import cut_lineage, remove_scratch, scratch_path
from ..sources.csv_folder import read_csv_folder
from ..sources.kept import KeptDays
from ..sources.kept_profile import KeptProfile
from ..sources.sinks import report_pages, report_payload, write_report, write_table
from ..sources.store import ReportStore
from .oracle import fmt_sql, insights_sql, q, rnd, safe_div_sql, thousands_sql
from .report import ReportTables, period_aggregate, range_metrics, run_range_report, run_report


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _comparison(cur: tuple, prev: tuple) -> dict:
    return {"current_start": cur[0], "current_end": cur[1], "previous_start": prev[0], "previous_end": prev[1]}


def _cfg(sources: dict, primary: str, date_col: str, dims: list, kpis: list, cur: tuple, prev: tuple,
         derived: dict | None = None, **report) -> dict:
    return {
        "dataset": {"primary_source": primary, "sources": sources},
        "derived_metrics": derived or {},
        "report": {"primary_date_col": date_col, "comparison": _comparison(cur, prev), "primary_dims": dims,
                   "kpi_priority": kpis, **report},
    }


# ---------------------------------------------------------------- flagship
FLAG_CUR = ("1998-01-01", "1998-12-31")
FLAG_PREV = ("1997-01-01", "1997-12-31")
FLAG_DIMS = ["l_returnflag", "l_linestatus"]
FLAG_KPIS = ["unit_price", "l_extendedprice", "l_quantity"]


def flagship_config(sf_dir: str, **report) -> dict:
    src = {"lineitem": {"type": "parquet", "path": f"{sf_dir.rstrip('/')}/lineitem.parquet",
                        "date_col": "l_shipdate", "dimensions": FLAG_DIMS,
                        "metrics": ["l_extendedprice", "l_quantity"]}}
    return _cfg(src, "lineitem", "l_shipdate", FLAG_DIMS, FLAG_KPIS, FLAG_CUR, FLAG_PREV,
                {"unit_price": "l_extendedprice / l_quantity"}, **report)


def flagship_report(spark: SparkSession, sf_dir: str, plan: str = "fused", **report) -> ReportTables:
    return run_report(spark, config_from_dict(flagship_config(sf_dir, **report)), plan=plan)


FLAG_METRICS_SQL = {"l_extendedprice": "l_extendedprice", "l_quantity": "l_quantity",
                    "unit_price": safe_div_sql("l_extendedprice", "l_quantity")}


def flagship_sql(top_n=20, decimal=False) -> str:
    return insights_sql("SELECT * FROM lineitem", "CAST(l_shipdate AS DATE)", FLAG_DIMS, FLAG_METRICS_SQL,
                        FLAG_KPIS, FLAG_CUR, FLAG_PREV, top_n, decimal=decimal)


def q_flagship(spark, sf_dir):
    return flagship_report(spark, sf_dir).insights


def q_flagship_decimal(spark, sf_dir):
    """Same report with the exact decimal accumulator (order-independent sums)."""
    return flagship_report(spark, sf_dir, accumulator="decimal").insights


def q_flagship_literal(spark, sf_dir):
    """Same report through two per-period aggregates and a full outer join."""
    return flagship_report(spark, sf_dir, plan="literal").insights


# ---------------------------------------------------------- derived metrics
DERIVED = {
    "disc_amount": "l_extendedprice * l_discount",
    "net_price": "l_extendedprice - disc_amount",
    "qty_plus_tax": "l_quantity + l_tax",
    "disc_per_tax": "l_discount / l_tax",
    "unit_net": "net_price / l_quantity",
}


def q_derived_metrics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    out = compute_all_derived_metrics(li, DERIVED)
    return out.select("l_orderkey", "l_linenumber", *DERIVED.keys())


SQL_DERIVED = f"""
WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity, l_tax, l_extendedprice, l_discount,
  CAST(l_extendedprice AS DOUBLE) * CAST(l_discount AS DOUBLE) AS disc_amount FROM lineitem),
b AS (SELECT *, CAST(l_extendedprice AS DOUBLE) - CAST(disc_amount AS DOUBLE) AS net_price FROM a)
SELECT l_orderkey, l_linenumber, disc_amount, net_price,
  CAST(l_quantity AS DOUBLE) + CAST(l_tax AS DOUBLE) AS qty_plus_tax,
  {safe_div_sql('l_discount', 'l_tax')} AS disc_per_tax,
  {safe_div_sql('net_price', 'l_quantity')} AS unit_net
FROM b
"""


# -------------------------------------------------------------- date parsing
def _parse_dates(spark, sf_dir, spark_fmt):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", spark_fmt).alias("o_orderdate"))
    return parse_date_column(o, "o_orderdate")


q_parse_dates = partial(_parse_dates, spark_fmt="MM/dd/yyyy")
q_parse_dates_day_first = partial(_parse_dates, spark_fmt="dd/MM/yyyy")
SQL_PARSE_DATES = ("SELECT o_orderkey, CAST(strptime(strftime(o_orderdate, '%m/%d/%Y'), '%m/%d/%Y') AS DATE) "
                   "AS o_orderdate FROM orders")
SQL_PARSE_DATES_DAY_FIRST = ("SELECT o_orderkey, CAST(strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') "
                             "AS DATE) AS o_orderdate FROM orders")


# -------------------------------------------------------------- period split
EV_CUR = ("2024-01-24", "2024-01-30")
EV_PREV_OVERLAP = ("2024-01-17", "2024-01-24")  # shares one day with the current period


def q_period_split(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("event_day"))
    cfg = config_from_dict(_cfg({"events": {"type": "table", "table": "events", "date_col": "event_day"}},
                                "events", "event_day", [], [], EV_CUR, EV_PREV_OVERLAP))
    flagged = flag_periods(ev, "event_day", cfg.report.comparison)
    return flagged.withColumnsRenamed({IN_CURRENT: "in_current", IN_PREVIOUS: "in_previous"})


SQL_PERIOD_SPLIT = f"""
SELECT event_id, CAST(ts AS DATE) AS event_day,
  CAST(ts AS DATE) BETWEEN DATE '{EV_CUR[0]}' AND DATE '{EV_CUR[1]}' AS in_current,
  CAST(ts AS DATE) BETWEEN DATE '{EV_PREV_OVERLAP[0]}' AND DATE '{EV_PREV_OVERLAP[1]}' AS in_previous
FROM events
WHERE CAST(ts AS DATE) BETWEEN DATE '{EV_CUR[0]}' AND DATE '{EV_CUR[1]}'
   OR CAST(ts AS DATE) BETWEEN DATE '{EV_PREV_OVERLAP[0]}' AND DATE '{EV_PREV_OVERLAP[1]}'
"""


# -------------------------------------------------------------- aggregation
def q_aggregate_by_dims(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return aggregate_by_dimensions(o, ["o_orderstatus", "o_orderpriority"], ["o_totalprice", "absent_metric"])


SQL_AGG_BY_DIMS = ("SELECT o_orderstatus, o_orderpriority, coalesce(sum(o_totalprice), 0) AS o_totalprice "
                   "FROM orders GROUP BY o_orderstatus, o_orderpriority")


def q_aggregate_global(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return aggregate_by_dimensions(p, [], ["p_size", "p_retailprice"])


SQL_AGG_GLOBAL = ("SELECT CAST(coalesce(sum(p_size), 0) AS BIGINT) AS p_size, "
                  "coalesce(sum(p_retailprice), 0) AS p_retailprice FROM part")


# -------------------------------------------------------------------- joins
def _lineitem_join_config() -> dict:
    return _cfg({"lineitem": {"type": "table", "table": "lineitem", "date_col": "l_shipdate"},
                 "part": {"type": "table", "table": "part", "date_col": "l_shipdate"},
                 "supplier": {"type": "table", "table": "supplier", "date_col": "l_shipdate"}},
                "lineitem", "l_shipdate", ["l_partkey", "l_suppkey"], [], FLAG_CUR, FLAG_PREV)


def q_join_sources(spark, sf_dir):
    """lineitem LEFT JOIN part, supplier on the shared dimension keys.

    ``supplier.s_name`` is renamed to ``p_name``, which ``part`` already
    brought: the first source's column is kept.
    """
    frames = {
        "lineitem": table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"),
        "part": table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_retailprice"),
        "supplier": table(spark, sf_dir, "supplier").select(
            F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("p_name"), "s_nationkey", "s_acctbal"),
    }
    return join_sources(frames, config_from_dict(_lineitem_join_config()))


SQL_JOIN_SOURCES = """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, l.l_shipdate,
       p.p_name, p.p_brand, p.p_retailprice, s.s_nationkey, s.s_acctbal
FROM lineitem l
LEFT JOIN part p ON l.l_partkey = p.p_partkey
LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
"""


def _customer_orders_frames(spark, sf_dir):
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    per_cust = (table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey"))
                .agg(F.count(F.lit(1)).alias("order_count"), F.sum("o_totalprice").alias("order_total")))
    return {"customer": cust, "orders": per_cust}


def _join_types(spark, sf_dir, how):
    cfg = config_from_dict(_cfg(
        {"customer": {"type": "table", "table": "customer", "date_col": "c_date"},
         "orders": {"type": "table", "table": "orders", "date_col": "c_date", "join_key": ["c_custkey"]}},
        "customer", "c_date", ["c_mktsegment"], [], FLAG_CUR, FLAG_PREV))
    return join_sources(_customer_orders_frames(spark, sf_dir), cfg, how=how)


q_join_inner = partial(_join_types, how="inner")
q_join_right = partial(_join_types, how="right")
q_join_outer = partial(_join_types, how="full_outer")


def _sql_join_types(kind: str) -> str:
    key = "coalesce(c.c_custkey, o.c_custkey)" if kind == "FULL OUTER" else (
        "o.c_custkey" if kind == "RIGHT" else "c.c_custkey")
    return f"""
WITH o AS (SELECT o_custkey AS c_custkey, count(*) AS order_count, sum(o_totalprice) AS order_total
           FROM orders GROUP BY o_custkey)
SELECT {key} AS c_custkey, c.c_mktsegment, c.c_acctbal, o.order_count, o.order_total
FROM customer c {kind} JOIN o ON c.c_custkey = o.c_custkey
"""


# ------------------------------------------------------------- period join
JP_CUR = ("1999-01-01", "1999-12-31")
JP_PREV = ("1998-01-01", "1998-12-31")


def _orders_by_customer(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_custkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_totalprice", F.lit(1).alias("order_count"))


def q_join_periods(spark, sf_dir):
    """Literal path: aggregate each period, full outer join, missing -> 0."""
    o = _orders_by_customer(spark, sf_dir)
    cfg = config_from_dict(_cfg({"orders": {"type": "table", "table": "orders", "date_col": "o_orderdate"}},
                                "orders", "o_orderdate", ["o_custkey"], [], JP_CUR, JP_PREV))
    cur = o.where(F.col("o_orderdate").between(F.lit(JP_CUR[0]).cast("date"), F.lit(JP_CUR[1]).cast("date")))
    prev = o.where(F.col("o_orderdate").between(F.lit(JP_PREV[0]).cast("date"), F.lit(JP_PREV[1]).cast("date")))
    metrics = ["o_totalprice", "order_count"]
    dims = list(cfg.report.primary_dims)
    return join_periods(aggregate_by_dimensions(cur, dims, metrics), aggregate_by_dimensions(prev, dims, metrics),
                        dims)


def q_period_aggregate(spark, sf_dir):
    """Fused path: both periods in one aggregate (same answer as join_periods)."""
    o = _orders_by_customer(spark, sf_dir)
    cfg = config_from_dict(_cfg(
        {"orders": {"type": "table", "table": "orders", "date_col": "o_orderdate",
                    "metrics": ["o_totalprice", "order_count"]}},
        "orders", "o_orderdate", ["o_custkey"], [], JP_CUR, JP_PREV))
    return period_aggregate(o, cfg, "o_orderdate")


SQL_JOIN_PERIODS = f"""
WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, o_totalprice FROM orders),
c AS (SELECT o_custkey, sum(o_totalprice) AS t, count(*) AS n FROM o
      WHERE d BETWEEN DATE '{JP_CUR[0]}' AND DATE '{JP_CUR[1]}' GROUP BY o_custkey),
p AS (SELECT o_custkey, sum(o_totalprice) AS t, count(*) AS n FROM o
      WHERE d BETWEEN DATE '{JP_PREV[0]}' AND DATE '{JP_PREV[1]}' GROUP BY o_custkey)
SELECT coalesce(c.o_custkey, p.o_custkey) AS o_custkey,
  coalesce(c.t, 0.0) AS o_totalprice_current, CAST(coalesce(c.n, 0) AS BIGINT) AS order_count_current,
  coalesce(p.t, 0.0) AS o_totalprice_previous, CAST(coalesce(p.n, 0) AS BIGINT) AS order_count_previous
FROM c FULL OUTER JOIN p ON c.o_custkey = p.o_custkey
"""


def q_join_periods_no_dims(spark, sf_dir):
    """No dimensions: the two one-row period aggregates side by side."""
    o = _orders_by_customer(spark, sf_dir)
    cur = o.where(F.col("o_orderdate").between(F.lit(JP_CUR[0]).cast("date"), F.lit(JP_CUR[1]).cast("date")))
    prev = o.where(F.col("o_orderdate").between(F.lit(JP_PREV[0]).cast("date"), F.lit(JP_PREV[1]).cast("date")))
    metrics = ["o_totalprice", "order_count"]
    return join_periods(aggregate_by_dimensions(cur, [], metrics), aggregate_by_dimensions(prev, [], metrics), [])


SQL_JOIN_PERIODS_NO_DIMS = f"""
WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d, o_totalprice FROM orders)
SELECT
  coalesce(sum(o_totalprice) FILTER (WHERE d BETWEEN DATE '{JP_CUR[0]}' AND DATE '{JP_CUR[1]}'), 0.0)
    AS o_totalprice_current,
  CAST(count(*) FILTER (WHERE d BETWEEN DATE '{JP_CUR[0]}' AND DATE '{JP_CUR[1]}') AS BIGINT) AS order_count_current,
  coalesce(sum(o_totalprice) FILTER (WHERE d BETWEEN DATE '{JP_PREV[0]}' AND DATE '{JP_PREV[1]}'), 0.0)
    AS o_totalprice_previous,
  CAST(count(*) FILTER (WHERE d BETWEEN DATE '{JP_PREV[0]}' AND DATE '{JP_PREV[1]}') AS BIGINT)
    AS order_count_previous
FROM o
"""


# ------------------------------------------------------ insights, no dims
ND_CUR = ("2000-01-01", "2000-12-31")
ND_PREV = ("1999-01-01", "1999-12-31")
ND_KPIS = ["o_totalprice", "order_count", "avg_price"]


def q_insights_no_dims(spark, sf_dir):
    return no_dims_report(spark, sf_dir).insights


def no_dims_report(spark, sf_dir) -> ReportTables:
    o = table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice", F.lit(1).alias("order_count"))
    cfg = config_from_dict(_cfg(
        {"orders": {"type": "table", "table": "orders", "date_col": "o_orderdate",
                    "metrics": ["o_totalprice", "order_count"]}},
        "orders", "o_orderdate", [], ND_KPIS, ND_CUR, ND_PREV, {"avg_price": "o_totalprice / order_count"}))
    return run_report(spark, cfg, frames={"orders": o})


def q_breakdown_no_dims(spark, sf_dir):
    """Without dimensions the breakdown is by metric: |impact| of its last row among the first 6."""
    return no_dims_report(spark, sf_dir).breakdown


SQL_INSIGHTS_NO_DIMS = insights_sql(
    "SELECT * FROM orders", "CAST(o_orderdate AS DATE)", [],
    {"o_totalprice": "o_totalprice", "order_count": "1", "avg_price": safe_div_sql("o_totalprice", "1")},
    ND_KPIS, ND_CUR, ND_PREV, 20)


SQL_BREAKDOWN_NO_DIMS = (
    f"WITH r AS ({SQL_INSIGHTS_NO_DIMS}), g AS (SELECT metric AS label, "
    f"{rnd('arg_max(abs(impact_score), rank)', 4)} AS value, min(rank) AS first FROM r WHERE rank <= 6 "
    f"GROUP BY metric) SELECT label, value, CAST(row_number() OVER (ORDER BY value DESC, first) AS INTEGER) "
    f"AS position FROM g QUALIFY position <= 6")


# ------------------------------------------------------ top-N, min impact
TN_CUR = ("2024-01-16", "2024-01-30")
TN_PREV = ("2024-01-01", "2024-01-15")
TN_DIMS = ["user_id", "event_type"]
TN_KPIS = ["value", "events"]


def _events_config(top_n, min_impact, dims=TN_DIMS) -> dict:
    return _cfg({"events": {"type": "table", "table": "events", "date_col": "ts", "metrics": ["value", "events"]}},
                "events", "ts", dims, TN_KPIS, TN_CUR, TN_PREV, top_n=top_n, min_impact=min_impact)


def _events_frame(spark, sf_dir):
    return table(spark, sf_dir, "events").select(*TN_DIMS, "ts", "value", F.lit(1).alias("events"))


def q_top_n_min_impact(spark, sf_dir):
    cfg = config_from_dict(_events_config(25, 50.0))
    return run_report(spark, cfg, frames={"events": _events_frame(spark, sf_dir)}).insights


def q_full_ranking_per_key(spark, sf_dir):
    """Every insight of every event type ranked within its type."""
    cfg = _events_config(None, 0.0, dims=["user_id"])
    cfg["report"]["report_key"] = ["event_type"]
    return run_report(spark, config_from_dict(cfg), frames={"events": _events_frame(spark, sf_dir)}).insights


def q_full_ranking(spark, sf_dir):
    """Every insight ranked (no limit): numbering spread over range partitions."""
    cfg = config_from_dict(_events_config(None, 0.0))
    return run_report(spark, cfg, frames={"events": _events_frame(spark, sf_dir)}).insights


EV_METRICS_SQL = {"value": "value", "events": "1"}
SQL_TOP_N_MIN_IMPACT = insights_sql("SELECT * FROM events", "CAST(ts AS DATE)", TN_DIMS, EV_METRICS_SQL, TN_KPIS,
                                    TN_CUR, TN_PREV, 25, 50.0)
SQL_FULL_RANKING_PER_KEY = insights_sql("SELECT * FROM events", "CAST(ts AS DATE)", ["user_id"], EV_METRICS_SQL, TN_KPIS,
                                        TN_CUR, TN_PREV, None, 0.0, keys=["event_type"])
SQL_FULL_RANKING = insights_sql("SELECT * FROM events", "CAST(ts AS DATE)", TN_DIMS, EV_METRICS_SQL, TN_KPIS,
                                TN_CUR, TN_PREV, None, 0.0)


# ------------------------------------------------------- values beyond 1e12
LARGE_FACTOR = 987654321.123


def q_large_values(spark, sf_dir):
    """One report row per order, values from 1e11 to beyond 1e14: rounding where x * 10^4 has no fraction left."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", (F.col("o_totalprice") * F.lit(LARGE_FACTOR)).alias("volume"))
    cfg = config_from_dict(_cfg(
        {"orders": {"type": "table", "table": "orders", "date_col": "o_orderdate", "metrics": ["volume"]}},
        "orders", "o_orderdate", ["o_orderkey"], ["volume"], JP_CUR, JP_PREV, top_n=None))
    return run_report(spark, cfg, frames={"orders": o}).insights


SQL_LARGE_VALUES = insights_sql("SELECT * FROM orders", "CAST(o_orderdate AS DATE)", ["o_orderkey"],
                                {"volume": f"o_totalprice * {LARGE_FACTOR!r}::DOUBLE"}, ["volume"], JP_CUR, JP_PREV, None)


# --------------------------------- decimal sums with NaN and infinite values
NONFINITE = ("CASE WHEN l_linenumber = 2 AND l_returnflag = 'A' AND l_shipdate >= {cur} THEN {inf} "
             "WHEN l_linenumber = 3 AND l_returnflag = 'N' AND l_orderkey % 5 = 0 THEN {nan} ELSE l_extendedprice END")


def q_decimal_nonfinite(spark, sf_dir):
    """lineitem with infinite and NaN prices among the others, summed by the decimal accumulator."""
    amount = NONFINITE.format(cur=f"TIMESTAMP_NTZ'{FLAG_CUR[0]}'", inf="double('infinity')", nan="double('NaN')")
    li = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag", "l_linestatus", "l_shipdate", "l_quantity", f"{amount} AS amount")
    cfg = config_from_dict(_cfg(
        {"lineitem": {"type": "table", "table": "lineitem", "date_col": "l_shipdate", "metrics": ["amount", "l_quantity"]}},
        "lineitem", "l_shipdate", FLAG_DIMS, ["amount", "l_quantity"], FLAG_CUR, FLAG_PREV, accumulator="decimal"))
    return run_report(spark, cfg, frames={"lineitem": li}).insights


SQL_DECIMAL_NONFINITE = insights_sql(
    "SELECT * FROM lineitem", "CAST(l_shipdate AS DATE)", FLAG_DIMS,
    {"amount": NONFINITE.format(cur=f"TIMESTAMP '{FLAG_CUR[0]}'", inf="'infinity'::DOUBLE", nan="'nan'::DOUBLE"),
     "l_quantity": "l_quantity"}, ["amount", "l_quantity"], FLAG_CUR, FLAG_PREV, 20, decimal=True)


# ------------------------------------------------- exact sums of all magnitudes
MAGNITUDES = "CAST(round(l_extendedprice * 100) AS {whole}) * CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END"


def q_exact_sums(spark, sf_dir):
    """Sums of both signs and of magnitudes 2^0 to 2^70 per group, correctly rounded (accumulator ``exact``), not rounded further."""
    li = table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag", "l_linestatus", "l_shipdate", "l_quantity", "l_linenumber",
        f"CAST({MAGNITUDES.format(whole='BIGINT')} AS DOUBLE) * pow(2.0D, 10 * l_linenumber) AS amount")
    cfg = config_from_dict(_cfg(
        {"lineitem": {"type": "table", "table": "lineitem", "date_col": "l_shipdate", "metrics": ["amount", "l_quantity", "l_linenumber"]}},
        "lineitem", "l_shipdate", FLAG_DIMS, ["amount"], FLAG_CUR, FLAG_PREV, accumulator="exact"))
    fact = parse_date_column(li, "l_shipdate")
    return period_aggregate(fact, cfg, "l_shipdate")


def _sql_exact_sums() -> str:
    """Whole numbers of 128 bits, read as doubles through their decimal text."""
    cols = []
    for suf, (a, b) in (("current", FLAG_CUR), ("previous", FLAG_PREV)):
        within = f"FILTER (WHERE d BETWEEN DATE '{a}' AND DATE '{b}')"
        cols += [f"CAST(CAST(coalesce(sum(amount) {within}, 0) AS VARCHAR) AS DOUBLE) AS amount_{suf}",
                 f"coalesce(sum(l_quantity) {within}, 0) AS l_quantity_{suf}",
                 f"CAST(coalesce(sum(l_linenumber) {within}, 0) AS BIGINT) AS l_linenumber_{suf}"]
    amount = f"{MAGNITUDES.format(whole='HUGEINT')} * (CAST(1 AS HUGEINT) << CAST(10 * l_linenumber AS INTEGER))"
    return (f"SELECT l_returnflag, l_linestatus, {', '.join(cols)} FROM (SELECT *, CAST(l_shipdate AS DATE) AS d, {amount} AS amount FROM lineitem) "
            f"WHERE d BETWEEN DATE '{FLAG_PREV[0]}' AND DATE '{FLAG_CUR[1]}' GROUP BY ALL")


# ----------------------------------------------------- many comparison ranges
N_RANGES = 1000


def many_ranges(spark) -> DataFrame:
    """Every second day from 1993 on begins a range of four weeks, compared with the four weeks before."""
    return spark.range(N_RANGES).selectExpr(
        "id AS range_id", "date_add(DATE'1993-01-01', CAST(2 * id AS INT)) AS current_start").selectExpr(
        "*", "date_add(current_start, 27) AS current_end", "date_sub(current_start, 28) AS previous_start",
        "date_sub(current_start, 1) AS previous_end")


def q_insights_many_ranges(spark, sf_dir):
    """1,000 comparison ranges, the best 3 insights of each, from one scan of lineitem."""
    return run_range_report(spark, config_from_dict(flagship_config(sf_dir, top_n=3)), many_ranges(spark)).insights


SQL_MANY_RANGES = insights_sql(
    f"""SELECT range_id, l.*, pd FROM (
  SELECT i AS range_id, DATE '1993-01-01' + CAST(2 * i AS INTEGER) AS cs FROM range({N_RANGES}) t(i)) r,
  (VALUES (DATE '2000-01-02', 0, 27), (DATE '2000-01-01', -28, -1)) p(pd, a, b), lineitem l
  WHERE CAST(l_shipdate AS DATE) BETWEEN cs + CAST(a AS INTEGER) AND cs + CAST(b AS INTEGER)""",
    "pd", FLAG_DIMS, FLAG_METRICS_SQL, FLAG_KPIS, ("2000-01-02", "2000-01-02"), ("2000-01-01", "2000-01-01"), 3, decimal=True, keys=["range_id"])


# ----------------------------------------------------------- kept daily sums
def q_insights_kept_days(spark, sf_dir):
    """The same from kept daily sums: lineitem arrives in two parts, the second refresh reads the second part only."""
    path = scratch_path(spark, f"kept_days-{uuid.uuid4().hex}")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *FLAG_DIMS, "l_shipdate", "l_extendedprice", "l_quantity")
    cfg = config_from_dict(flagship_config(sf_dir, top_n=3))
    kept = KeptDays(
        spark, f"{path}/kept", lambda files: spark.read.schema(li.schema).parquet(*files), "l_shipdate", FLAG_DIMS,
        range_metrics(compute_all_derived_metrics(li, cfg.derived_metrics), cfg),
        prepare=lambda rows: compute_all_derived_metrics(rows, cfg.derived_metrics))
    for part in (0, 1):
        li.where(F.pmod(F.xxhash64("l_orderkey"), F.lit(2)) == part).write.parquet(f"{path}/source/part={part}")
        kept.refresh(f"{path}/source")
    return read_back(run_range_report(spark, cfg, many_ranges(spark), daily=kept.daily()).insights, path)


# ------------------------------------------------------ date column fallback
def q_date_fallback(spark, sf_dir):
    """The configured date column is absent: the first column named like a date is taken."""
    ev = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("event_date"), "value", F.lit(1).alias("events"))
    cfg = config_from_dict(_cfg(
        {"events": {"type": "table", "table": "events", "date_col": "day", "metrics": ["value", "events"]}},
        "events", "day", ["event_type"], TN_KPIS, TN_CUR, TN_PREV))
    return run_report(spark, cfg, frames={"events": ev}).insights


# --------------------------------------------------- one report per nation
PR_KPIS = ["o_totalprice", "order_count"]


def per_nation_config(top_n: int = 5) -> dict:
    return _cfg(
        {"orders": {"type": "table", "table": "orders", "date_col": "o_orderdate",
                    "metrics": ["o_totalprice", "order_count"]},
         "customer": {"type": "table", "table": "customer", "date_col": "o_orderdate", "join_key": ["c_custkey"]},
         "nation": {"type": "table", "table": "nation", "date_col": "o_orderdate", "join_key": ["c_nationkey"]}},
        "orders", "o_orderdate", ["c_mktsegment"], PR_KPIS, FLAG_CUR, FLAG_PREV,
        top_n=top_n, report_key=["n_name"])


def per_nation_frames(spark, sf_dir):
    return {
        "orders": table(spark, sf_dir, "orders").select(
            F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_totalprice", F.lit(1).alias("order_count")),
        "customer": table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"),
        "nation": table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"),
    }


def per_nation_report(spark, sf_dir) -> ReportTables:
    return run_report(spark, config_from_dict(per_nation_config()), frames=per_nation_frames(spark, sf_dir))


def q_insights_per_report(spark, sf_dir):
    return per_nation_report(spark, sf_dir).insights


PER_NATION_FACT = """SELECT o.o_orderdate, o.o_totalprice, c.c_mktsegment, n.n_name
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey"""
SQL_PER_REPORT = insights_sql(PER_NATION_FACT, "CAST(o_orderdate AS DATE)", ["c_mktsegment"],
                              {"o_totalprice": "o_totalprice", "order_count": "1"}, PR_KPIS, FLAG_CUR, FLAG_PREV,
                              5, 0.0, keys=["n_name"])


def read_back(df: DataFrame, path: str) -> DataFrame:
    """Rows read from a scratch folder, cut from it, so that the folder can go."""
    out = cut_lineage(df)
    remove_scratch(df.sparkSession, path)
    return out


def q_report_sink(spark, sf_dir):
    """The report per nation written partitioned by its key, and the insights table read back."""
    path = scratch_path(spark, f"report_sink-{uuid.uuid4().hex}")
    tables = per_nation_report(spark, sf_dir)
    target = write_report(tables, path)["insights"]
    back = spark.read.parquet(target)
    return read_back(back.select(*tables.insights.columns, F.col("dimensions")["c_mktsegment"].alias("segment_text")), path)


def _region_report(spark, sf_dir, regions: list[int], cur: tuple, prev: tuple) -> ReportTables:
    cfg = per_nation_config()
    cfg["dataset"]["join_type"] = "inner"
    cfg["report"]["comparison"] = _comparison(cur, prev)
    frames = per_nation_frames(spark, sf_dir)
    frames["nation"] = table(spark, sf_dir, "nation").where(F.col("n_regionkey").isin(regions)).select(
        F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return run_report(spark, config_from_dict(cfg), frames=frames)


STORE_RUNS = [([0, 1, 2], FLAG_CUR, FLAG_PREV), ([2, 3], ("1997-01-01", "1997-12-31"), ("1996-01-01", "1996-12-31"))]


def q_report_store(spark, sf_dir):
    """Two runs into one report store: the second replaces the nations of its regions, the others keep the first run's
    reports. Older versions are removed, then the insights of all reports are read."""
    path = scratch_path(spark, f"report_store-{uuid.uuid4().hex}")
    store = ReportStore(spark, path, ["n_name"])
    for regions, cur, prev in STORE_RUNS:
        store.publish_report(_region_report(spark, sf_dir, regions, cur, prev))
    store.vacuum(keep=1)
    periods = store.read("meta").select("n_name", "current_period")
    return read_back(store.read("insights").drop("dimensions").join(periods, "n_name"), path)


def _sql_report_store() -> str:
    parts = []
    for k, (regions, cur, prev) in enumerate(STORE_RUNS):
        mine = [r for r in regions if not any(r in later for later, _, _ in STORE_RUNS[k + 1:])]
        fact = f"{PER_NATION_FACT} WHERE n.n_regionkey IN ({', '.join(map(str, mine))})"
        one = insights_sql(fact, "CAST(o_orderdate AS DATE)", ["c_mktsegment"], {"o_totalprice": "o_totalprice", "order_count": "1"},
                           PR_KPIS, cur, prev, 5, 0.0, keys=["n_name"])
        parts.append(f"SELECT *, '{cur[0]} to {cur[1]}' AS current_period FROM ({one})")
    return " UNION ALL ".join(parts)


SQL_REPORT_SINK = f"SELECT *, c_mktsegment AS segment_text FROM ({SQL_PER_REPORT})"


def q_report_payload(spark, sf_dir):
    """The JSON payload per nation, written, read back and laid out as rows."""
    path = scratch_path(spark, f"report_payload-{uuid.uuid4().hex}")
    payload = report_payload(per_nation_report(spark, sf_dir))
    write_table(payload, path, "json")
    back = spark.read.schema(payload.schema).json(path).select(
        "n_name", "summary.total_insights", "config.current_period", F.posexplode("insights").alias("place", "i"))
    return read_back(back.select("n_name", "total_insights", "current_period", (F.col("place") + 1).alias("rank"),
                                 F.col("i.dimensions")["c_mktsegment"].alias("segment"), "i.metric", "i.current_value",
                                 "i.previous_value", "i.delta", "i.delta_pct", "i.impact_score", "i.direction"), path)


SQL_REPORT_PAYLOAD = (
    f"SELECT n_name, count(*) OVER (PARTITION BY n_name) AS total_insights, '{FLAG_CUR[0]} to {FLAG_CUR[1]}' AS current_period, rank, "
    f"c_mktsegment AS segment, metric, current_value, previous_value, delta, delta_pct, impact_score, direction FROM ({SQL_PER_REPORT})")


def q_summary_per_report(spark, sf_dir):
    s = per_nation_report(spark, sf_dir).summary
    cols = [F.col("n_name"), F.col("total_insights"), F.col("total_gains"), F.col("total_drops")]
    for rec in ("top_mover", "biggest_gain", "biggest_drop"):
        for fld in ("rank", "metric", "c_mktsegment", "delta_pct"):
            cols.append(F.col(f"{rec}.{fld}").alias(f"{rec}_{fld}"))
    return s.select(*cols)


def _sql_summary_per_report() -> str:
    flds = ("rank", "metric", "c_mktsegment", "delta_pct")
    picks = {"top_mover": ("TRUE", "rank"), "biggest_gain": ("direction = 'up'", "delta_pct DESC, rank"),
             "biggest_drop": ("direction = 'down'", "delta_pct ASC, rank")}
    ctes, joins, cols = [], [], []
    for rec, (where, order) in picks.items():
        sel = ", ".join(f"{f} AS {rec}_{f}" for f in flds)
        ctes.append(f"{rec} AS (SELECT n_name, {sel} FROM (SELECT *, row_number() OVER (PARTITION BY n_name "
                    f"ORDER BY {order}) AS o FROM r WHERE {where}) WHERE o = 1)")
        joins.append(f"LEFT JOIN {rec} USING (n_name)")
        cols += [f"{rec}_{f}" for f in flds]
    return (f"WITH r AS ({SQL_PER_REPORT}), s AS (SELECT n_name, count(*) AS total_insights, "
            f"count(*) FILTER (WHERE direction = 'up') AS total_gains, "
            f"count(*) FILTER (WHERE direction = 'down') AS total_drops FROM r GROUP BY n_name), "
            f"{', '.join(ctes)} SELECT s.n_name, total_insights, total_gains, total_drops, {', '.join(cols)} "
            f"FROM s {' '.join(joins)}")


def q_totals_per_report(spark, sf_dir):
    return per_nation_report(spark, sf_dir).totals


def _sql_totals_per_report() -> str:
    from .oracle import aggregate_sql
    agg = aggregate_sql(PER_NATION_FACT, "CAST(o_orderdate AS DATE)", ["n_name", "c_mktsegment"],
                        {"o_totalprice": "o_totalprice", "order_count": "1"}, FLAG_CUR, FLAG_PREV)
    parts = " UNION ALL ".join(
        f"SELECT n_name, '{m}' AS metric, {rnd('coalesce(sum(CAST(' + q(m + '_current') + ' AS DOUBLE)), 0.0)', 4)} "
        f"AS current_total, {rnd('coalesce(sum(CAST(' + q(m + '_previous') + ' AS DOUBLE)), 0.0)', 4)} "
        f"AS previous_total FROM agg GROUP BY n_name" for m in PR_KPIS)
    return (f"WITH agg AS ({agg}), t AS ({parts}) SELECT *, CAST(row_number() OVER (PARTITION BY n_name "
            f"ORDER BY current_total + previous_total DESC, metric) AS INTEGER) AS position FROM t "
            f"QUALIFY position <= 6")


# ------------------------------------------------- summary-level tables
def q_insight_summary(spark, sf_dir):
    s = flagship_report(spark, sf_dir).summary
    cols = [F.col("total_insights"), F.col("total_gains"), F.col("total_drops")]
    for rec in ("top_mover", "biggest_gain", "biggest_drop"):
        for fld in ("rank", "metric", "l_returnflag", "l_linestatus", "delta_pct", "impact_score", "direction"):
            cols.append(F.col(f"{rec}.{fld}").alias(f"{rec}_{fld}"))
    return s.select(*cols)


def _summary_pick(where: str, order: str) -> str:
    return f"(SELECT {{f}} FROM r WHERE {where} ORDER BY {order} LIMIT 1)"


def _sql_summary() -> str:
    picks = {"top_mover": ("TRUE", "rank"),
             "biggest_gain": ("direction = 'up'", "delta_pct DESC, rank"),
             "biggest_drop": ("direction = 'down'", "delta_pct ASC, rank")}
    cols = ["count(*) AS total_insights", "count(*) FILTER (WHERE direction = 'up') AS total_gains",
            "count(*) FILTER (WHERE direction = 'down') AS total_drops"]
    for rec, (where, order) in picks.items():
        for fld in ("rank", "metric", "l_returnflag", "l_linestatus", "delta_pct", "impact_score", "direction"):
            cols.append(_summary_pick(where, order).format(f=fld) + f" AS {rec}_{fld}")
    return f"WITH r AS ({flagship_sql()}) SELECT {', '.join(cols)} FROM r"


def q_period_totals(spark, sf_dir):
    return flagship_report(spark, sf_dir).totals


def _sql_totals() -> str:
    from .oracle import aggregate_sql
    agg = aggregate_sql("SELECT * FROM lineitem", "CAST(l_shipdate AS DATE)", FLAG_DIMS, FLAG_METRICS_SQL,
                        FLAG_CUR, FLAG_PREV)
    parts = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {rnd('coalesce(sum(CAST(' + q(m + '_current') + ' AS DOUBLE)), 0.0)', 4)} "
        f"AS current_total, {rnd('coalesce(sum(CAST(' + q(m + '_previous') + ' AS DOUBLE)), 0.0)', 4)} "
        f"AS previous_total FROM agg"
        for m in ["l_extendedprice", "l_quantity", "unit_price"])
    return (f"WITH agg AS ({agg}), t AS ({parts}) SELECT *, CAST(row_number() OVER "
            f"(ORDER BY current_total + previous_total DESC, metric) AS INTEGER) AS position FROM t "
            f"QUALIFY position <= 6")


def q_dimension_breakdown(spark, sf_dir):
    return flagship_report(spark, sf_dir).breakdown


SQL_BREAKDOWN = (f"WITH r AS ({flagship_sql()}), g AS (SELECT l_returnflag AS label, "
                 f"{rnd('sum(abs(current_value))', 4)} AS value, min(rank) AS first FROM r WHERE rank <= 10 GROUP BY l_returnflag) "
                 f"SELECT label, value, CAST(row_number() OVER (ORDER BY value DESC, first) AS INTEGER) AS position "
                 f"FROM g QUALIFY position <= 6")


def q_kpi_cards(spark, sf_dir):
    return flagship_report(spark, sf_dir).cards


SQL_KPI_CARDS = f"""
WITH r AS ({flagship_sql()})
SELECT rank, metric,
  CASE WHEN current_value >= 1000000 THEN {fmt_sql('current_value / 1000000.0::DOUBLE', 1)} || 'M'
       WHEN current_value >= 1000 THEN {fmt_sql('current_value / 1000.0::DOUBLE', 1)} || 'K'
       ELSE {fmt_sql('current_value', 0)} END AS value_text,
  CASE WHEN direction = 'up' THEN '↑ +' || {fmt_sql('delta_pct', 1)} || '%'
       WHEN direction = 'down' THEN '↓ ' || {fmt_sql('delta_pct', 1)} || '%'
       ELSE '→ ' || {fmt_sql('delta_pct', 1)} || '%' END AS trend_text
FROM r WHERE rank <= 4
"""


def q_insight_table(spark, sf_dir):
    return flagship_report(spark, sf_dir).table


SQL_INSIGHT_TABLE = f"""
WITH r AS ({flagship_sql()})
SELECT rank,
  'l_returnflag: ' || l_returnflag || ', l_linestatus: ' || l_linestatus AS segment,
  upper(metric) AS metric,
  CASE WHEN direction = 'up' THEN '↑' WHEN direction = 'down' THEN '↓' ELSE '→' END || ' '
    || {fmt_sql('delta_pct', 1, sign=True)} || '%' AS change,
  repeat('█', CAST(floor(least(greatest(impact_score * 5.0::DOUBLE, 0.0::DOUBLE), 10.0::DOUBLE)) AS INTEGER))
    || ' ' || {fmt_sql('impact_score', 2)} AS impact
FROM r WHERE rank <= 6
"""


def q_narrative(spark, sf_dir):
    n = per_nation_report(spark, sf_dir).narrative
    return n.select("n_name", "title", "headline", *[F.col("bullets")[i].alias(f"bullet_{i + 1}") for i in range(3)],
                    "recommendation")


def _sql_narrative() -> str:
    bullet = (f"upper(metric) || ' for c_mktsegment=' || coalesce(c_mktsegment, 'None') || ': ' || "
              f"{thousands_sql('current_value')} || ' → ' || {thousands_sql('previous_value')} || ' (' || "
              f"{fmt_sql('delta_pct', 1, sign=True)} || '%)'")
    pad = "'Additional analysis pending.'"
    return f"""
WITH r AS ({SQL_PER_REPORT}),
b AS (SELECT n_name, rank, metric, direction, delta_pct, {bullet} AS bullet FROM r WHERE rank <= 3)
SELECT n_name, 'Performance Analysis Report' AS title,
  'Key Finding: ' || upper(max(metric) FILTER (WHERE rank = 1)) || ' '
    || CASE WHEN max(direction) FILTER (WHERE rank = 1) = 'up' THEN 'increased' ELSE 'decreased' END
    || ' by ' || {fmt_sql('abs(max(delta_pct) FILTER (WHERE rank = 1))', 1)} || '% in the current period.'
    AS headline,
  coalesce(max(bullet) FILTER (WHERE rank = 1), {pad}) AS bullet_1,
  coalesce(max(bullet) FILTER (WHERE rank = 2), {pad}) AS bullet_2,
  coalesce(max(bullet) FILTER (WHERE rank = 3), {pad}) AS bullet_3,
  CASE WHEN max(direction) FILTER (WHERE rank = 1) = 'up'
       THEN 'Continue monitoring ' || max(metric) FILTER (WHERE rank = 1)
            || ' performance and identify factors contributing to the positive trend.'
       ELSE 'Investigate the decline in ' || max(metric) FILTER (WHERE rank = 1)
            || ' and implement corrective measures to reverse the trend.' END AS recommendation
FROM b GROUP BY n_name
"""


# ---------------------------------------------------------------- profiling
ORDERS_COLUMNS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                  ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]
ORDERS_ROLES = {"o_orderkey": "dimension", "o_custkey": "dimension", "o_orderstatus": "dimension",
                "o_totalprice": "metric", "o_orderdate": "date", "o_orderpriority": "dimension"}


def q_column_profile(spark, sf_dir):
    prof = column_profile(table(spark, sf_dir, "orders"))
    return prof.drop("distinct_estimate")


def _sql_date_like(c: str) -> str:
    """The count of the format that parses most values."""
    counts = [f"count(try_strptime({c}, '{f}'))" for f in ("%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%d/%m/%Y")]
    return f"greatest({', '.join(counts)}, count(TRY_CAST({c} AS DATE)))"


def _sql_profile() -> str:
    parts = []
    for i, (c, t) in enumerate(ORDERS_COLUMNS):
        if t == "timestamp_ntz":
            like = f"count({c})"
        elif t == "string":
            like = _sql_date_like(c)
        else:
            like = "0"
        parts.append(
            f"SELECT '{c}' AS column_name, {i} AS ordinal, '{t}' AS data_type, count(*) AS row_count, "
            f"count({c}) AS non_null_count, count(*) - count({c}) AS null_count, "
            f"CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS null_rate, "
            f"CAST({like} AS BIGINT) AS date_like_count, '{ORDERS_ROLES[c]}' AS role FROM orders")
    return " UNION ALL ".join(parts)


def q_column_profile_labels(spark, sf_dir):
    """0/1 columns are categories by their few values; the distinct estimate is held against the exact count."""
    labels = table(spark, sf_dir, "labels")
    exact = labels.agg(*[F.count_distinct(c).alias(c) for c in labels.columns]).unpivot([], labels.columns, "name", "exact")
    prof = column_profile(labels)
    close = F.abs(F.col("distinct_estimate") - F.col("exact")) <= 0.15 * F.col("exact")  # three standard deviations
    return (prof.join(exact, F.col("column_name") == F.col("name"))
            .select("column_name", "data_type", "null_rate", "role", close.alias("estimate_close")))


SQL_PROFILE_LABELS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS data_type, CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS null_rate, "
    f"'dimension' AS role, TRUE AS estimate_close FROM labels" for c, t in (("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")))


def _text_dates(spark, sf_dir) -> DataFrame:
    """orders with its date as text: month first and day first in turn, then day first, then month first."""
    d = F.col("o_orderdate")
    month, day = F.date_format(d, "MM/dd/yyyy"), F.date_format(d, "dd/MM/yyyy")
    return table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 2 == 0, month).otherwise(day).alias("mixed_date"), day.alias("paid"), month.alias("due_date"), "o_totalprice")


def q_column_profile_dates(spark, sf_dir):
    """A text column that mixes month first and day first is no date, whatever its name; the first with one format is."""
    return column_profile(_text_dates(spark, sf_dir)).select("column_name", "non_null_count", "date_like_count", "role")


SQL_TEXT_DATES = """SELECT CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS mixed_date,
  strftime(o_orderdate, '%d/%m/%Y') AS paid, strftime(o_orderdate, '%m/%d/%Y') AS due_date, o_totalprice FROM orders"""
SQL_PROFILE_DATES = f"WITH t AS ({SQL_TEXT_DATES}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS non_null_count, CAST({_sql_date_like(c) if role != 'metric' else '0'} AS BIGINT) AS date_like_count, "
    f"'{role}' AS role FROM t" for c, role in (("mixed_date", "dimension"), ("paid", "date"), ("due_date", "dimension"), ("o_totalprice", "metric")))


def q_suggested_ranges_text(spark, sf_dir):
    """Ranges from a date column that is text, month first."""
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "MM/dd/yyyy").alias("o.date"))
    return suggested_ranges(o, "o.date")


def q_suggested_ranges(spark, sf_dir):
    return suggested_ranges(table(spark, sf_dir, "orders"), "o_orderdate")


SQL_SUGGESTED_RANGES = """
WITH a AS (SELECT CAST(max(o_orderdate) AS DATE) AS d FROM orders)
SELECT strftime(d, '%Y-%m-%d') AS anchor,
  strftime(d - INTERVAL 7 DAY, '%Y-%m-%d') AS current_start, strftime(d, '%Y-%m-%d') AS current_end,
  strftime(d - INTERVAL 14 DAY, '%Y-%m-%d') AS previous_start,
  strftime(d - INTERVAL 8 DAY, '%Y-%m-%d') AS previous_end
FROM a
"""


# ------------------------------------------------------------ CSV round trip
def q_csv_source(spark, sf_dir):
    """events -> ';' CSV in the shared scratch folder -> CSV source -> report.

    The delimiter is sniffed from the header line; a schema spares the reader
    its inference pass (tests cover inference).
    """
    path = scratch_path(spark, f"csv_source-{uuid.uuid4().hex}")
    (table(spark, sf_dir, "events")
     .select(F.to_date("ts").alias("event_day"), "event_type", "value", F.lit(1).alias("events"))
     .write.option("header", True).option("sep", ";").csv(path))
    cfg = config_from_dict(_cfg(
        {"events": {"type": "csv", "path": path, "date_col": "event_day", "metrics": ["value", "events"],
                    "schema": "event_day DATE, event_type STRING, value DOUBLE, events INT"}},
        "events", "event_day", ["event_type"], TN_KPIS, TN_CUR, TN_PREV))
    return read_back(run_report(spark, cfg).insights, path)


SQL_CSV_SOURCE = insights_sql("SELECT * FROM events", "CAST(ts AS DATE)", ["event_type"], EV_METRICS_SQL, TN_KPIS,
                              TN_CUR, TN_PREV, 20)


# --------------------------------------------- reports over the documents table
DOC_CUR, DOC_PREV = ("2025-01-08", "2025-01-14"), ("2025-01-01", "2025-01-07")
DOC_DAY = "date_add(DATE'2025-01-01', CAST(doc_id % 14 AS INT))"
SQL_DOCS = "SELECT doc_id, source, lang, n_chars, DATE '2025-01-01' + CAST(doc_id % 14 AS INTEGER) AS day, 1 AS docs FROM documents"


def _documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", F.expr(DOC_DAY).alias("day"), F.lit(1).alias("docs"))


def q_join_hot_keys(spark, sf_dir):
    """Documents joined with one row per source, of which one holds a third of all rows: hot sources salted, then the report."""
    docs = _documents(spark, sf_dir)
    feeds = docs.groupBy("source").agg(F.count(F.lit(1)).alias("feed_docs"), F.sum("n_chars").alias("feed_chars"))
    cfg = _cfg({"docs": {"type": "table", "table": "docs", "date_col": "day", "metrics": ["n_chars"]},
                "feeds": {"type": "table", "table": "feeds", "date_col": "day", "metrics": ["feed_docs"], "join_key": ["source"]}},
               "docs", "day", ["lang", "source"], ["share", "feed_docs", "n_chars"], DOC_CUR, DOC_PREV, {"share": "n_chars * feed_docs"}, top_n=50)
    cfg["dataset"]["hot_keys"] = True
    return run_report(spark, config_from_dict(cfg), frames={"docs": docs, "feeds": feeds}).insights


SQL_JOIN_HOT_KEYS = insights_sql(
    f"SELECT d.*, f.feed_docs FROM ({SQL_DOCS}) d LEFT JOIN (SELECT source, count(*) AS feed_docs FROM documents GROUP BY source) f ON d.source = f.source",
    "day", ["lang", "source"], {"n_chars": "n_chars", "feed_docs": "feed_docs", "share": "CAST(n_chars AS DOUBLE) * CAST(feed_docs AS DOUBLE)"},
    ["share", "feed_docs", "n_chars"], DOC_CUR, DOC_PREV, 50)

PAGE_ROWS = 1000


def q_report_pages(spark, sf_dir):
    """Every insight of every document ranked per language, written as JSON pages of 1,000, read back and laid out as rows."""
    path = scratch_path(spark, f"report_pages-{uuid.uuid4().hex}")
    cfg = _cfg({"docs": {"type": "table", "table": "docs", "date_col": "day", "metrics": ["n_chars", "docs"]}}, "docs", "day", ["doc_id"],
               ["n_chars", "docs"], DOC_CUR, DOC_PREV, top_n=None, report_key=["lang"])
    pages = report_pages(run_report(spark, config_from_dict(cfg), frames={"docs": _documents(spark, sf_dir)}), PAGE_ROWS)
    write_table(pages, path, "json")
    back = spark.read.schema(pages.schema).json(path).select(
        "lang", "page", "next_page", "page_count", "first_rank", F.posexplode("insights").alias("place", "i"))
    return read_back(back.select("lang", "page", "next_page", "page_count", (F.col("first_rank") + F.col("place")).alias("rank"),
                                 F.col("i.dimensions")["doc_id"].cast("long").alias("doc_id"), "i.metric", "i.current_value",
                                 "i.previous_value", "i.delta", "i.delta_pct", "i.impact_score", "i.direction"), path)


SQL_REPORT_PAGES = (
    "SELECT lang, page, CASE WHEN page < max(page) OVER (PARTITION BY lang) THEN page + 1 END AS next_page, "
    "CAST(count(*) OVER (PARTITION BY lang, page) AS INTEGER) AS page_count, rank, doc_id, metric, current_value, previous_value, delta, delta_pct, "
    f"impact_score, direction FROM (SELECT *, (rank - 1) // {PAGE_ROWS} + 1 AS page FROM ("
    + insights_sql(SQL_DOCS, "day", ["doc_id"], {"n_chars": "n_chars", "docs": "docs"}, ["n_chars", "docs"], DOC_CUR, DOC_PREV, None, keys=["lang"]) + "))")


def q_kept_profile(spark, sf_dir):
    """Profile of documents that arrive in two parts, from sketches kept per file; the second refresh reads the second part only.
    Distinct estimates are compared with the exact counts (4 %), medians by their place among the values (2 %)."""
    path = scratch_path(spark, f"kept_profile-{uuid.uuid4().hex}")
    docs = _documents(spark, sf_dir).drop("docs")
    kept = KeptProfile(spark, f"{path}/kept", docs.schema)
    for part in (0, 1):
        docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == part).write.parquet(f"{path}/source/part={part}")
        kept.refresh(f"{path}/source")
    prof = cut_lineage(kept.profile())
    remove_scratch(spark, path)
    median = {c: prof.where(F.col("column_name") == c).select(F.get("quantiles", F.lit(2))).scalar() for c in ("doc_id", "n_chars")}
    exact = docs.agg(*[F.count_distinct(F.col(c)).alias(f"u_{c}") for c in docs.columns],
                     *[F.struct(F.avg((F.col(c) < m).cast("int")).alias("below"), F.avg((F.col(c) <= m).cast("int")).alias("upto")).alias(f"m_{c}")
                       for c, m in median.items()])
    rows = exact.select(F.stack(F.lit(len(docs.columns)), *[x for c in docs.columns for x in (
        F.lit(c), F.col(f"u_{c}"), F.col(f"m_{c}") if c in median else F.lit(None).cast("struct<below:double,upto:double>"))]).alias("name", "exact", "at"))
    return prof.join(rows, F.col("column_name") == F.col("name")).select(
        "column_name", "ordinal", "data_type", "row_count", "null_count", "date_like_count", "role",
        (F.abs(F.col("distinct_estimate") - F.col("exact")) <= 0.04 * F.col("exact")).alias("estimate_close"),
        ((F.col("at.below") <= 0.52) & (F.col("at.upto") >= 0.48)).alias("median_close"))


SQL_KEPT_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {i} AS ordinal, '{t}' AS data_type, count(*) AS row_count, count(*) - count({c}) AS null_count, "
    f"{d} AS date_like_count, '{r}' AS role, TRUE AS estimate_close, {m} AS median_close FROM ({SQL_DOCS})"
    for i, (c, t, r, d, m) in enumerate((
        ("doc_id", "bigint", "dimension", "0", "TRUE"), ("source", "string", "dimension", "0", "NULL"), ("lang", "string", "dimension", "0", "NULL"),
        ("n_chars", "bigint", "metric", "0", "TRUE"), ("day", "date", "date", "count(day)", "NULL"))))

# per part of documents: delimiter, columns in their order
CSV_LAYOUTS = [(",", ["doc_id", "source", "lang", "n_chars", "day"]), (";", ["day", "n_chars", "lang", "source", "doc_id"]),
               ("\t", ["source", "day", "doc_id", "n_chars"])]


def _csv_folder(spark, sf_dir):
    """documents as CSV files of three layouts (one without lang), and once more every 97th with a length that is no number."""
    path = scratch_path(spark, f"csv_folder-{uuid.uuid4().hex}")
    docs = _documents(spark, sf_dir).drop("docs")
    for i, (sep, columns) in enumerate(CSV_LAYOUTS):
        docs.where(F.col("doc_id") % 3 == i).select(*columns).write.csv(f"{path}/part{i}", sep=sep, header=True)
    docs.where(F.col("doc_id") % 97 == 0).select("doc_id", "source", F.concat(F.col("n_chars").cast("string"), F.lit("?")).alias("n_chars"), "day").write.csv(
        f"{path}/bad", header=True)
    return path


def q_csv_folder(spark, sf_dir):
    """A report over a folder of CSV files of several layouts, every file read by its own header."""
    path = _csv_folder(spark, sf_dir)
    cfg = config_from_dict(_cfg(
        {"docs": {"type": "csv", "path": path, "date_col": "day", "own_headers": True, "metrics": ["n_chars"],
                  "schema": "day DATE, doc_id BIGINT, source STRING, lang STRING, n_chars BIGINT"}},
        "docs", "day", ["source", "lang"], ["n_chars"], DOC_CUR, DOC_PREV, top_n=None))
    return read_back(run_report(spark, cfg).insights, path)


SQL_CSV_FOLDER = insights_sql(f"SELECT * REPLACE (CASE WHEN doc_id % 3 < 2 THEN lang END AS lang) FROM ({SQL_DOCS})", "day", ["source", "lang"],
                              {"n_chars": "n_chars"}, ["n_chars"], DOC_CUR, DOC_PREV, None)


def q_csv_folder_malformed(spark, sf_dir):
    """The rows of that folder that do not fit their file's header."""
    path = _csv_folder(spark, sf_dir)
    folder = read_csv_folder(spark, path, "day DATE, doc_id BIGINT, source STRING, lang STRING, n_chars BIGINT")
    return read_back(folder.malformed.select("record", "reason"), path)


SQL_CSV_FOLDER_MALFORMED = (f"SELECT doc_id || ',' || coalesce(source, '') || ',' || coalesce(n_chars || '?', '') || ',' || strftime(day, '%Y-%m-%d') AS record, "
                            f"'values' AS reason FROM ({SQL_DOCS}) WHERE doc_id % 97 = 0 AND n_chars IS NOT NULL")


# ------------------------------------------------------------------ streaming
def q_streaming_flagship(spark, sf_dir):
    """Flagship over lineitem read as a file stream; result read back from the sink."""
    from ..streaming import file_stream, published, stream_report
    cfg = config_from_dict(flagship_config(sf_dir))
    sink = scratch_path(spark, f"stream_sink-{uuid.uuid4().hex}")
    stream = file_stream(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet")
    query = stream_report(cfg, stream, f"{sink}/tables", checkpoint_location=f"{sink}/checkpoint")
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return read_back(published(spark, f"{sink}/tables", "insights").drop("dimensions"), sink)


# ------------------------------------------------------------------ registry
QUERIES = {
    "flagship_insights": q_flagship,
    "flagship_insights_literal": q_flagship_literal,
    "flagship_insights_decimal": q_flagship_decimal,
    "derived_metrics": q_derived_metrics,
    "parse_dates": q_parse_dates,
    "parse_dates_day_first": q_parse_dates_day_first,
    "period_split": q_period_split,
    "aggregate_by_dims": q_aggregate_by_dims,
    "aggregate_global": q_aggregate_global,
    "join_sources": q_join_sources,
    "join_sources_inner": q_join_inner,
    "join_sources_right": q_join_right,
    "join_sources_outer": q_join_outer,
    "join_periods": q_join_periods,
    "period_aggregate": q_period_aggregate,
    "insights_no_dims": q_insights_no_dims,
    "join_periods_no_dims": q_join_periods_no_dims,
    "dimension_breakdown_no_dims": q_breakdown_no_dims,
    "summary_per_report": q_summary_per_report,
    "totals_per_report": q_totals_per_report,
    "top_n_min_impact": q_top_n_min_impact,
    "full_ranking": q_full_ranking,
    "full_ranking_per_key": q_full_ranking_per_key,
    "large_values": q_large_values,
    "decimal_nonfinite": q_decimal_nonfinite,
    "exact_sums": q_exact_sums,
    "insights_many_ranges": q_insights_many_ranges,
    "insights_kept_days": q_insights_kept_days,
    "date_fallback": q_date_fallback,
    "report_sink": q_report_sink,
    "report_payload": q_report_payload,
    "report_store": q_report_store,
    "insights_per_report": q_insights_per_report,
    "insight_summary": q_insight_summary,
    "period_totals": q_period_totals,
    "dimension_breakdown": q_dimension_breakdown,
    "kpi_cards": q_kpi_cards,
    "insight_table": q_insight_table,
    "narrative": q_narrative,
    "column_profile": q_column_profile,
    "column_profile_labels": q_column_profile_labels,
    "column_profile_dates": q_column_profile_dates,
    "suggested_ranges": q_suggested_ranges,
    "suggested_ranges_text": q_suggested_ranges_text,
    "csv_source": q_csv_source,
    "join_hot_keys": q_join_hot_keys,
    "report_pages": q_report_pages,
    "kept_profile": q_kept_profile,
    "csv_folder": q_csv_folder,
    "csv_folder_malformed": q_csv_folder_malformed,
    "streaming_flagship": q_streaming_flagship,
}


def oracle_statements() -> dict[str, str]:
    return {
        "flagship_insights": flagship_sql(),
        "flagship_insights_literal": flagship_sql(),
        "flagship_insights_decimal": flagship_sql(decimal=True),
        "derived_metrics": SQL_DERIVED,
        "parse_dates": SQL_PARSE_DATES,
        "parse_dates_day_first": SQL_PARSE_DATES_DAY_FIRST,
        "period_split": SQL_PERIOD_SPLIT,
        "aggregate_by_dims": SQL_AGG_BY_DIMS,
        "aggregate_global": SQL_AGG_GLOBAL,
        "join_sources": SQL_JOIN_SOURCES,
        "join_sources_inner": _sql_join_types("INNER"),
        "join_sources_right": _sql_join_types("RIGHT"),
        "join_sources_outer": _sql_join_types("FULL OUTER"),
        "join_periods": SQL_JOIN_PERIODS,
        "period_aggregate": SQL_JOIN_PERIODS,
        "insights_no_dims": SQL_INSIGHTS_NO_DIMS,
        "join_periods_no_dims": SQL_JOIN_PERIODS_NO_DIMS,
        "dimension_breakdown_no_dims": SQL_BREAKDOWN_NO_DIMS,
        "summary_per_report": _sql_summary_per_report(),
        "totals_per_report": _sql_totals_per_report(),
        "top_n_min_impact": SQL_TOP_N_MIN_IMPACT,
        "full_ranking": SQL_FULL_RANKING,
        "full_ranking_per_key": SQL_FULL_RANKING_PER_KEY,
        "large_values": SQL_LARGE_VALUES,
        "decimal_nonfinite": SQL_DECIMAL_NONFINITE,
        "exact_sums": _sql_exact_sums(),
        "insights_many_ranges": SQL_MANY_RANGES,
        "insights_kept_days": SQL_MANY_RANGES,
        "date_fallback": SQL_CSV_SOURCE,
        "report_sink": SQL_REPORT_SINK,
        "report_payload": SQL_REPORT_PAYLOAD,
        "report_store": _sql_report_store(),
        "insights_per_report": SQL_PER_REPORT,
        "insight_summary": _sql_summary(),
        "period_totals": _sql_totals(),
        "dimension_breakdown": SQL_BREAKDOWN,
        "kpi_cards": SQL_KPI_CARDS,
        "insight_table": SQL_INSIGHT_TABLE,
        "narrative": _sql_narrative(),
        "column_profile": _sql_profile(),
        "column_profile_labels": SQL_PROFILE_LABELS,
        "column_profile_dates": SQL_PROFILE_DATES,
        "suggested_ranges": SQL_SUGGESTED_RANGES,
        "suggested_ranges_text": SQL_SUGGESTED_RANGES,
        "csv_source": SQL_CSV_SOURCE,
        "join_hot_keys": SQL_JOIN_HOT_KEYS,
        "report_pages": SQL_REPORT_PAGES,
        "kept_profile": SQL_KEPT_PROFILE,
        "csv_folder": SQL_CSV_FOLDER,
        "csv_folder_malformed": SQL_CSV_FOLDER_MALFORMED,
        "streaming_flagship": flagship_sql(),
    }
