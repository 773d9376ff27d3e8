"""Connected components of a table of links by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, label) of every linked id: label is the smallest id that it can reach.

    Each round points every id and its neighbours at the smallest id in its
    neighbourhood, until all that is left are stars. Minima are pre-aggregated
    before the shuffle; the edges stay in the cluster, written out each round.
    Raises ``RuntimeError`` if ``rounds`` do not settle it, which takes chains
    longer than any power of two that the rounds allow.
    """
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
    for _ in range(rounds):
        each = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = each.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        near = each.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.select("u", F.col("m").alias("v"))
        edges = stored(near.unionByName(own).filter("u <> v").distinct(), "links")
        # Settled: every id has one edge, and no label has an edge of its own.
        state = edges.groupBy("u").agg(F.count("*").alias("n"))
        again = edges.select(F.col("v").alias("u")).distinct().join(state, "u", "left_semi")
        if state.filter("n > 1").select("u").unionByName(again).isEmpty():
            own = edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
            return own.unionByName(own.select(F.col("label").alias("id"), "label").distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
