"""Connected components of links between ids of any one type that has an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import table


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of each id that a link names; component is the smallest id that it reaches.

    Alternating stars: every id hangs its larger neighbours, then its smaller ones, on the smallest; the rounds until nothing moves
    grow with the logarithm of a component's size, not with its diameter. Neighbours are reduced by aggregation and joined
    back, so no task gathers those of one id. Each round is a table in the shared folder. Null ends are left out.
    """
    u, v = F.col(a), F.col(b)
    edges = table(links.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "links")
    state = None
    while (now := tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())) != state:
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        up = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = edges.join(least, "u").select("u", F.col("m").alias("v"))
        large = table(up.unionByName(own).where("u <> v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = table(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
    found = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return found.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def families(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, family) of every id of the bipartite links (a, b, each with names of its own): the least name reached."""
    return components(links, a, b).withColumnRenamed("component", "family")
