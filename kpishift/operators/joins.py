"""Joining sources into one fact table, and the literal period join."""

from __future__ import annotations

import logging
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import InsightConfig
from ..functions.numeric import col
from .hotjoin import join_hot_keys, same_key_types

log = logging.getLogger(__name__)


def default_join_keys(config: InsightConfig) -> list[str]:
    """Report key + dimensions + the primary source's date column."""
    keys = list(config.report.report_key) + list(config.report.primary_dims)
    date_col = config.dataset.primary.date_col
    if date_col not in keys:
        keys.append(date_col)
    return keys


def join_sources(frames: dict[str, DataFrame], config: InsightConfig, how: str | None = None) -> DataFrame:
    """Equi-join every secondary source onto the primary (LEFT by default).

    Keys are the default keys present on both sides, or the source's own
    ``join_key`` when given. Columns the running result already has are not
    taken again (first source wins). A source sharing no key is skipped.
    Right-side rows with repeated keys multiply primary rows, as in any
    equi-join. Broadcast vs. shuffle is left to Spark: the planner broadcasts
    a side only under ``spark.sql.autoBroadcastJoinThreshold`` (runtime size
    under AQE) and otherwise sort-merges, with AQE splitting skewed partitions;
    ``hot_keys`` in the dataset spreads hot keys ahead of the shuffle (keys of one type on both sides).
    """
    primary_name = config.dataset.primary_source
    result = frames[primary_name]
    how = how or config.dataset.join_type
    keys = default_join_keys(config)
    for name, df in frames.items():
        if name == primary_name:
            continue
        src = config.dataset.sources.get(name)
        wanted = list(src.join_key) if src is not None and src.join_key else keys
        common = [k for k in wanted if k in df.columns and k in result.columns]
        if not common:
            log.warning("source %r shares no join key with %r; skipped", name, primary_name)
            continue
        extra = [c for c in df.columns if c not in result.columns]
        order = result.columns + extra  # primary columns keep their place, new ones follow
        right = df.select(*[col(c) for c in common + extra])
        if config.dataset.hot_keys and same_key_types(result, right, common):
            joined = join_hot_keys(result, right, common, how)
        else:
            joined = result.join(right, on=common, how=how)
        result = joined.select(*[col(c) for c in order])
    return result


def _suffixed(df: DataFrame, dims: list[str], suffix: str) -> DataFrame:
    return df.select(*[col(d) for d in dims], *[col(c).alias(f"{c}_{suffix}") for c in df.columns if c not in dims])


def join_periods(current: DataFrame, previous: DataFrame, dims: list[str]) -> DataFrame:
    """Full outer join of two per-period aggregates on ``dims``; missing -> 0.

    Plain key equality: a null dimension value never matches, so it yields
    two rows, each against 0. Without dims the two one-row aggregates are
    merged into one row (a union and a one-row aggregate, no cross join).
    """
    dims = list(dims)
    cur = _suffixed(current, dims, "current")
    prev = _suffixed(previous, dims, "previous")
    value_cols = [c for c in cur.columns if c not in dims] + [c for c in prev.columns if c not in dims]
    if dims:
        joined = cur.join(prev, on=dims, how="full_outer")
    else:
        both = cur.unionByName(prev, allowMissingColumns=True)
        joined = both.agg(*[F.max(col(c)).alias(c) for c in value_cols]) if value_cols else both.limit(1)
    return joined.na.fill(0, subset=value_cols) if value_cols else joined
