"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: longs); component is its smallest reachable node.

    Each half step needs only minima over a node's neighbours (partially
    aggregated before the shuffle) and a join with them, so a node with many
    neighbours is never gathered; each round is written to the shared folder.
    Null ends and loops are ignored; no edges give no rows.
    """
    pair = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = saved(pair, "star")
    state = _state(now)
    for _ in range(max_rounds if state[0] else 0):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("center")).agg(F.min("v").alias("m"))
        large = (both.join(least, F.col("u") == F.col("center")).where("v > u")
                 .select(F.col("v").alias("u"), F.least("m", "u").alias("v")))
        low = large.groupBy(F.col("u").alias("center")).agg(F.min("v").alias("m"))
        small = (large.join(low, F.col("u") == F.col("center")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select(F.col("center").alias("u"), F.col("m").alias("v"))).distinct())
        before, now = now, saved(small, "star")
        after = _state(now)
        discard(before)  # the new table is written
        if after == state:
            break
        state = after
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
