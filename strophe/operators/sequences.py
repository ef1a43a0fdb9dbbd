"""Sequences of lines and statements: cuts, windows with context, runs that count others, and answers stitched together."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import merged


def minus(ranges: DataFrame, cuts: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """(by, start, end): what is left of inclusive ranges of whole numbers, overlapping ones made one, outside the cuts.

    No range meets a cut in a join: along the line, cover and cut are sums of openings and closings.
    """
    as_rows = lambda df, kind: merged(df.select(*by, F.col(start).alias("a"), (F.col(end) + 1).alias("b")), by, "a", "b").select(*by, F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("step")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("step")))).alias("x"), F.lit(kind).alias("kind"))
    marks = as_rows(ranges, "range").unionByName(as_rows(cuts, "cut"))
    at = marks.groupBy(*by, F.col("x.at").alias("at")).agg(*(F.sum(F.when(F.col("kind") == k, F.col("x.step")).otherwise(0)).alias(k) for k in ("range", "cut")))
    w = Window.partitionBy(*by).orderBy("at")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    state = at.select(*by, "at", (F.sum("range").over(so_far) > 0).alias("in_"), (F.sum("cut").over(so_far) > 0).alias("out_"), F.lead("at").over(w).alias("next_"))
    left = state.where(F.col("in_") & ~F.col("out_") & F.col("next_").isNotNull()).select(*by, F.col("at").alias("a"), F.col("next_").alias("b"))
    return merged(left, by, "a", "b").select(*by, F.col("a").alias(start), (F.col("b") - 1).alias(end))


def line_windows(lines: DataFrame, by: list[str], order: str, length: str, most: int) -> DataFrame:
    """(by, window, first, last, n_chars, shown_first, shown_last): cores of at most `most` characters, one line at least, and the lines
    shown with them: as many on either side as have most // 4 characters together.

    The lines of one document are one row of the function, many documents to a batch.
    """
    margin = most // 4
    keys = ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in by)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for key, at, sizes in zip(pdf[by].itertuples(index=False, name=None), pdf["at"], pdf["sizes"]):
                ends, total = [], 0  # characters up to each line
                for n in sizes:
                    total += n
                    ends.append(total)
                before = lambda k: ends[k - 1] if k else 0
                start, window = 0, 0
                while start < len(sizes):
                    stop = start + 1
                    while stop < len(sizes) and (ends[stop] - before(start) <= most or ends[stop - 1] == before(start)):
                        stop += 1
                    low, high = start, stop - 1
                    while low > 0 and before(start) - before(low - 1) <= margin:
                        low -= 1
                    while high + 1 < len(sizes) and ends[high + 1] - ends[stop - 1] <= margin:
                        high += 1
                    rows.append((*key, window, at[start], at[stop - 1], ends[stop - 1] - before(start), at[low], at[high]))
                    start, window = stop, window + 1
            yield pd.DataFrame(rows, columns=[*by, "window", "first", "last", "n_chars", "shown_first", "shown_last"])

    sorted_ = F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("at"), F.col(length).cast("long").alias("n"))))
    rows = lines.groupBy(*by).agg(sorted_.alias("l")).select(*by, F.col("l.at").alias("at"), F.col("l.n").alias("sizes"))
    return rows.mapInPandas(cut, f"{keys}, window long, first long, last long, n_chars long, shown_first long, shown_last long")


def stitched(starts: DataFrame, by: list[str], start: str, end: str, last: Column) -> DataFrame:
    """starts with `until`: an answer runs to the line before the next start, or to its own end if that is the next start's line; the last
    one to `last`."""
    following = F.lead(start).over(Window.partitionBy(*by).orderBy(start))
    return starts.withColumn("until", F.when(following.isNull(), last).when(F.col(end) == following, following).otherwise(F.greatest(following - 1, F.col(start))))


def chart_parents(items: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, order, parent): items (ordinal: whether marked, count: how many it announces or null) as a tree: an item that announces k
    takes the next k marked items that no later one takes before. Items without ordinal and count are left out."""
    kinds = ", ".join(f"{c} {items.schema[c].dataType.simpleString()}" for c in by)

    def grown(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for key, own in zip(pdf[by].itertuples(index=False, name=None), pdf["items"]):
                open_: list[list] = []  # of items that still wait: place, how many
                for item in own:
                    marked, count = item["marked"], item["count"]
                    count = 0 if count is None or count != count else int(count)
                    if not marked and not count:
                        continue
                    if marked and open_:
                        rows.append((*key, item["at"], open_[-1][0]))
                        open_[-1][1] -= 1
                        while open_ and not open_[-1][1]:
                            open_.pop()
                    else:
                        rows.append((*key, item["at"], None))
                        open_ = []
                    if count:
                        open_.append([item["at"], count])
            yield pd.DataFrame(rows, columns=[*by, order, "parent"]).astype({order: "Int64", "parent": "Int64"})

    item = F.struct(F.col(order).cast("long").alias("at"), F.col("ordinal").alias("marked"), F.col("count").cast("long").alias("count"))
    return items.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items")).mapInPandas(grown, f"{kinds}, {order} long, parent long")


def unit_ends(units: DataFrame, by: list[str], order: str, level: str, last: Column) -> DataFrame:
    """units with `end_at`: the place before the next unit of the same or a shallower level; `last` for those without one.

    One aggregate per level: a unit's bar is the next place at any level up to its own. Units are read backwards, since a frame that
    ends at the last row is computed anew for each row.
    """
    w = Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    levels = [r[0] for r in units.select(level).distinct().orderBy(level).collect()]  # levels of a tree are few
    following = F.lit(None).cast("bigint")
    bars = []
    for k in levels:
        bars.append(F.min(F.when(F.col(level) <= k, F.col(order))).over(w))
    for k, bar in zip(levels, bars):
        following = F.when(F.col(level) == k, bar).otherwise(following)
    return units.withColumn("end_at", F.coalesce(following - 1, last))


def merged_blanks(pieces: DataFrame, by: list[str], order: str, blank: Column, barred: Column) -> DataFrame:
    """pieces with `unit`: a blank piece joins the one before it, or at the start the one after it, but never across a bar (`barred`: a bar
    stands before the piece)."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = pieces.withColumns({"b_": blank, "bar_": F.coalesce(barred, F.lit(False))})
    back = F.lag("b_").over(w).isNotNull() & F.col("b_") & ~F.col("bar_")
    rows = rows.withColumn("unit_", F.sum(F.when(back, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    units = rows.groupBy(*by, "unit_").agg(F.every("b_").alias("b_"), F.max_by("bar_", -F.col(order)).alias("bar_"))
    v = Window.partitionBy(*by).orderBy("unit_")
    forward = F.lag("b_").over(v) & ~F.col("bar_")
    units = units.withColumn("unit", F.sum(F.when(F.coalesce(forward, F.lit(False)), 0).otherwise(1)).over(v.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.join(units.select(*by, "unit_", "unit"), [*by, "unit_"]).drop("unit_", "b_", "bar_")
