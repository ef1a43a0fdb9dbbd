"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, table


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of each id that a link names; component is the smallest id that it reaches.

    Rounds of stars hang each id on smaller ones until nothing moves, a number of rounds that grows with the
    logarithm of a component's size. Neighbours are reduced by aggregation and joined back, so no task gathers
    those of one id. Each round is a table in the shared folder.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    edges = links.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    edges = table(edges, "links")
    state, first = _state(edges), True
    while first or state != before:
        before, first = state, False
        if not state[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = table(large.where("u <> v").union(edges.join(least, "u").select("u", F.col("m").alias("v")).where("u <> v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        earlier, edges = edges, table(small.distinct(), "small")
        dropped(earlier, large)
        state = _state(edges)
    found = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return found.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
