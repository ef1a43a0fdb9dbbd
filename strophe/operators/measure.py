"""Tallies, distributions and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tally(df: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    """(by, value, n) with a bucket 'null'."""
    return df.groupBy(*(by or []), F.coalesce(value.cast("string"), F.lit("null")).alias("value")).agg(F.count("*").alias("n"))


def nearest_rank(df: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """Quantiles that are values of the data: the one at round-half-even(p * (n - 1)). Rows are counted by value before
    anything is sorted, so a group's task holds its distinct values only."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("k_"))
    w = Window.partitionBy(*by)
    placed = counts.select(*by, "v", F.sum("k_").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("k_").over(w).alias("n"))
    at = lambda p: F.bround(F.lit(p) * (F.col("n") - 1), 0).cast("bigint")
    return placed.groupBy(*by).agg(F.max("n").alias("n"), *(F.min(F.when(F.col("upto") > at(p), F.col("v"))).alias(name) for name, p in shares.items()))


def tiles_of(df: DataFrame, value: str, by: list[str], k: int) -> DataFrame:
    """(by, tile, n, total): rows in order of value in k tiles, the one ranked r of n in tile r * k // n; how many rows each holds
    and the sum of their values. Equal values are counted first and dealt to the tiles that their ranks touch."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("k_"))
    w = Window.partitionBy(*by)
    placed = counts.select(*by, "v", "k_", (F.sum("k_").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("k_")).alias("low"), F.sum("k_").over(w).alias("n_"))
    tile = lambda r: F.floor(r * k / F.col("n_"))
    touched = placed.withColumn("tile", F.explode(F.sequence(tile(F.col("low")), tile(F.col("low") + F.col("k_") - 1))))
    edge = lambda t: F.ceil(t * F.col("n_") / k)
    inside = F.least(edge(F.col("tile") + 1), F.col("low") + F.col("k_")) - F.greatest(edge(F.col("tile")), F.col("low"))
    return touched.groupBy(*by, "tile").agg(F.sum(inside).alias("n"), F.sum(inside * F.col("v")).alias("total"))


def histogram(df: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """(bin, low, high, n): bins low <= value < high between edges, the first and last open; empty bins are 0."""
    bounds = [None, *edges, None]
    bins = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))], "bin long, low double, high double")
    place = sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("bigint")
    counts = df.where(value.isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def precision_recall(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """p, r and f, rounded to 6; null where the denominator is 0."""
    share = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)
    return [share(tp, tp + fp).alias("p"), share(tp, tp + fn).alias("r"), share(2 * tp, 2 * tp + fp + fn).alias("f")]


def multiset_match(pred: DataFrame, gold: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """(by, tp, fp, fn, p, r, f): the multiset intersection of keys per group."""
    count = lambda df, n: df.groupBy(*by, *key).agg(F.count("*").alias(n))
    both = count(pred, "a").join(count(gold, "b"), [*by, *key], "full").fillna(0, ["a", "b"])
    sums = both.groupBy(*by).agg(F.sum(F.least("a", "b")).alias("tp"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("fn"))
    return sums.select(*by, "tp", "fp", "fn", *precision_recall(F.col("tp"), F.col("fp"), F.col("fn")))


def shares_over(df: DataFrame, key: str, limits: list[int]) -> DataFrame:
    """(more_than, share): the share of rows whose key is on more than so many rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("n")).groupBy().agg(F.sum("n").alias("all"), *(F.coalesce(F.sum(F.when(F.col("n") > k, F.col("n"))), F.lit(0)).alias(f"k{k}") for k in limits))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(k).cast("bigint").alias("more_than"), F.round(F.try_divide(F.col(f"k{k}"), F.col("all")), 6).alias("share")) for k in limits))).alias("x")).select("x.*")


def cumulative(df: DataFrame, key: str, size: Column, top: int) -> DataFrame:
    """(rank, key, size, cum_share) of the `top` largest groups; ties by key. Only the top rows meet in one task."""
    sizes = df.groupBy(key).agg(size.alias("size"))
    total = sizes.agg(F.sum("size")).head()[0] or 0
    first = sizes.orderBy(F.desc("size"), key).limit(top)
    w = Window.orderBy(F.desc("size"), key)
    return first.select(F.row_number().over(w).cast("bigint").alias("rank"), key, "size", F.round(F.try_divide(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double"), F.lit(float(total))), 6).alias("cum_share"))
