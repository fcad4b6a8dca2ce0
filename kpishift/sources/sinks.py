"""Persisting a report: insights, summary and run metadata as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import col, qi
from ..functions.text import value_str_sql


def with_dimension_map(insights: DataFrame, dims: list[str]) -> DataFrame:
    """Add ``dimensions`` (map name -> value text), as the payload shows them."""
    if dims:
        pairs = []
        for d in dims:
            pairs += [F.lit(d), F.expr(value_str_sql(qi(d), insights.schema[d].dataType))]
        m = F.create_map(*pairs)
    else:
        m = F.create_map().cast("map<string,string>")
    return insights.withColumn("dimensions", m)


def _record(dims: list[str], dim_types: dict):
    pairs = []
    for d in dims:
        pairs += [F.lit(d), F.expr(value_str_sql(qi(d), dim_types.get(d)))]
    dim_map = F.create_map(*pairs) if dims else F.create_map().cast("map<string,string>")
    return F.struct(dim_map.alias("dimensions"), *[F.col(c) for c in (
        "metric", "current_value", "previous_value", "delta", "delta_pct", "impact_score", "direction")])


def report_payload(tables) -> DataFrame:
    """One row per report: ``insights`` (array in rank order), ``summary``, ``config``.

    The JSON document a dashboard reads. Built from the top-N rows only
    (bounded per report); an unlimited ranking is refused rather than
    collected into one row: see :func:`report_pages`.
    """
    if not tables.config.report.top_n:
        raise ValueError("a payload needs top_n: an unlimited ranking is not collected into one row (see report_pages)")
    keys = list(tables.keys)
    dims = list(tables.dims)
    rec = _record(dims, tables.dim_types)
    up, down = F.col("direction") == "up", F.col("direction") == "down"
    aggs = [
        F.array_sort(F.collect_list(F.struct(F.col("rank"), rec.alias("r"))),
                     lambda a, b: F.signum(a["rank"] - b["rank"]).cast("int")).alias("_ranked"),
        F.count(F.lit(1)).alias("total_insights"),
        F.count_if(up).alias("total_gains"),
        F.count_if(down).alias("total_drops"),
        F.min_by(rec, F.col("rank")).alias("top_mover"),
        F.max_by(rec, F.when(up, F.struct(F.col("delta_pct"), -F.col("rank")))).alias("biggest_gain"),
        F.min_by(rec, F.when(down, F.struct(F.col("delta_pct"), F.col("rank")))).alias("biggest_drop"),
    ]
    g = tables.insights.groupBy(*keys).agg(*aggs) if keys else tables.insights.agg(*aggs)
    rep = tables.config.report
    config = F.struct(
        F.array(*[F.lit(d) for d in dims]).cast("array<string>").alias("dimensions"),
        F.array(*[F.lit(k) for k in rep.kpi_priority]).cast("array<string>").alias("kpis"),
        F.lit(rep.comparison.current_period).alias("current_period"),
        F.lit(rep.comparison.previous_period).alias("previous_period"),
    )
    summary = F.struct("total_insights", "total_gains", "total_drops", "top_mover", "biggest_gain",
                       "biggest_drop")
    return g.select(*keys, F.transform("_ranked", lambda x: x["r"]).alias("insights"), summary.alias("summary"),
                    config.alias("config"))


def report_pages(tables, page_rows: int = 1000) -> DataFrame:
    """The insights of a payload in pages: report keys, ``page`` (from 1), ``first_rank``, ``page_count``, ``next_page``, ``insights``.

    For rankings without a limit: a page holds at most ``page_rows`` insights in rank
    order, so no group grows with the report, and the reader asks for ``next_page`` until it is
    null. One shuffle by key and page: the first insight of a page also goes to
    the page before it, as the sign that another one follows.
    """
    if page_rows < 1:
        raise ValueError("a page has at least one row")
    keys = [col(k) for k in tables.keys]
    rank, number = F.col("rank").cast("long"), F.floor((F.col("rank") - 1) / F.lit(page_rows)).cast("long") + 1
    first = (rank - 1) % page_rows == 0
    here = F.struct(number.alias("page"), F.lit(False).alias("sign"))
    before = F.struct((number - 1).alias("page"), F.lit(True).alias("sign"))
    dealt = tables.insights.select(
        *keys, rank.alias("__kpi_rank"), _record(list(tables.dims), tables.dim_types).alias("__kpi_record"),
        F.explode(F.when(first & (number > 1), F.array(here, before)).otherwise(F.array(here))).alias("__kpi_at"))
    own = F.when(~F.col("__kpi_at.sign"), F.struct(F.col("__kpi_rank").alias("rank"), F.col("__kpi_record").alias("r")))
    page = F.col("__kpi_at.page").alias("page")
    pages = dealt.groupBy(*keys, page).agg(
        F.array_sort(F.collect_list(own), lambda a, b: F.signum(a["rank"] - b["rank"]).cast("int")).alias("__kpi_ranked"),
        F.bool_or("__kpi_at.sign").alias("__kpi_more"))
    return pages.select(
        *keys, "page", F.col("__kpi_ranked")[0]["rank"].alias("first_rank"), F.size("__kpi_ranked").alias("page_count"),
        F.when(F.col("__kpi_more"), F.col("page") + 1).alias("next_page"),
        F.transform("__kpi_ranked", lambda x: x["r"]).alias("insights"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None, bounded: bool = True) -> None:
    """``bounded``: a key has few rows (top-N), so it goes to one file; else Spark splits large keys over several."""
    if partition_by:
        by = [col(k) for k in partition_by]
        df = df.repartition(*by) if bounded else df.hint("rebalance", *by)
    writer = df.write.mode(mode).format(fmt)
    if partition_by:  # an overwrite replaces the keys that have rows and leaves the other keys' folders
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.save(path)


def report_frames(tables, extra: tuple = ()) -> list[tuple[str, DataFrame]]:
    """(name, rows) of the tables of a report that are written: insights, summary, meta and ``extra`` ones by name."""
    named = [("insights", with_dimension_map(tables.insights, tables.dims)), ("summary", tables.summary),
             ("meta", tables.meta)] + [(n, getattr(tables, n)) for n in extra if n not in ("payload", "pages")]
    if "payload" in extra:
        named.append(("payload", report_payload(tables)))
    if "pages" in extra:
        named.append(("pages", report_pages(tables)))
    return named


def write_report(tables, path: str, fmt: str = "parquet", mode: str = "overwrite",
                 extra: tuple = (), materialize: bool = True) -> dict[str, str]:
    """Write insights, summary, metadata (and ``extra`` tables by name, e.g.
    ``("totals", "narrative")``) under ``path``; returns the table paths.

    With ``materialize`` the facts are scanned and aggregated once for all
    tables (see ``ReportTables.materialize``). Per-report-key runs are
    partitioned by the key, so one report is one directory to read back; a
    run replaces the reports of its own keys. For readers that must
    not see half a run, and for a history, use :class:`kpishift.sources.store.ReportStore`.
    """
    if materialize:
        tables = tables.materialize()
    keys = list(tables.keys)
    out = {}
    for name, df in report_frames(tables, extra):
        target = f"{path.rstrip('/')}/{name}"
        write_table(df, target, fmt, mode, keys if keys and name != "meta" else None, bool(tables.top_n))
        out[name] = target
    return out
