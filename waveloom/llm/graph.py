"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, store


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component_id (the smallest node reachable) for each node with a link to another; edges: a, b.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) until nothing changes.  Minima
    are aggregated before the shuffle and joined back, so the hub of a star is never one task's group.
    Every round is written to the shared folder.  No edges: an empty result.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now = store(edges, "components")
    state = _state(now)
    while state[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = store(both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "components")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        following = store(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "components")
        was, state = state, _state(following)
        discard(now)
        discard(large)
        now = following
        if state == was:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component_id"))
