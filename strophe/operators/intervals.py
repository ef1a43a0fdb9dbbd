"""As-of, containment, overlap and band joins, and windows over intervals. Ends are exclusive unless named otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(probes: DataFrame, marks: DataFrame, by: list[str], at: str, mark_at: str, values: list[str], tie: str | None = None) -> DataFrame:
    """Each probe with the values of the last mark at or before it within `by`; null before the first.

    One union and one window: no range join. Marks at one place: the last by `tie` wins.
    """
    filler = [F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in probes.columns if c not in by]
    tie_of = F.col(tie) if tie else F.lit(0)
    left = probes.select(*by, F.col(at).alias("at_"), F.lit(1).alias("is_probe_"), F.lit(0).cast("double").alias("tie_"), F.lit(None).cast(marks.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("mark_"), *[F.col(c).alias(c) for c in probes.columns if c not in by])
    right = marks.select(*by, F.col(mark_at).alias("at_"), F.lit(0).alias("is_probe_"), tie_of.cast("double").alias("tie_"), F.struct(*values).alias("mark_"), *filler)
    order = Window.partitionBy(*by).orderBy("at_", "is_probe_", "tie_").rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("found_", F.last("mark_", ignorenulls=True).over(order)).where("is_probe_ = 1")
    return found.select(*probes.columns, *(F.col(f"found_.{v}").alias(v) for v in values))


def binned(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """A row per bin of `width` that the interval [start, end) touches."""
    bins = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    return df.where(F.col(start) < F.col(end)).withColumn("bin_", F.explode(bins))


def contained(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, width: int = 256) -> DataFrame:
    """Points joined to all spans that hold them: an equi-join on bins, then a filter."""
    return points.withColumn("bin_", F.floor(F.col(at) / width)).join(binned(spans, start, end, width), [*by, "bin_"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("bin_")


def overlapping(a: DataFrame, b: DataFrame, by: list[str], a_start: str, a_end: str, b_start: str, b_end: str, width: int = 256) -> DataFrame:
    """Pairs of intervals that share a place. A pair is given in the first bin that both touch, so once."""
    both = binned(a, a_start, a_end, width).join(binned(b, b_start, b_end, width), [*by, "bin_"])
    first = F.floor(F.greatest(F.col(a_start), F.col(b_start)) / width)
    return both.where((F.col(a_start) < F.col(b_end)) & (F.col(b_start) < F.col(a_end)) & (F.col("bin_") == first)).drop("bin_")


def within_band(a: DataFrame, b: DataFrame, by: list[str], a_at: str, b_at: str, tolerance: int) -> DataFrame:
    """Pairs at most `tolerance` apart: bins as wide as the tolerance, of which each row of b is in three."""
    width = max(1, tolerance)
    left = a.withColumn("bin_", F.floor(F.col(a_at) / width))
    right = b.withColumn("bin_", F.explode(F.expr(f"transform(array(-1, 0, 1), k -> floor(`{b_at}` / {width}) + k)")))
    return left.join(right, [*by, "bin_"]).where(F.abs(F.col(a_at) - F.col(b_at)) <= tolerance).drop("bin_")


def merged(spans: DataFrame, by: list[str], start: str, end: str, adjacent: bool = True) -> DataFrame:
    """(by, start, end, n_merged): overlapping spans, and with `adjacent` touching ones, made one."""
    order = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = reach.isNull() | ((F.col(start) > reach) if adjacent else (F.col(start) >= reach))
    numbered = spans.withColumn("opens_", opens.cast("int")).withColumn("run_", F.sum("opens_").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "run_").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("run_")


def tiles(spans: DataFrame, totals: DataFrame, by: list[str], start: str, end: str, total: str) -> DataFrame:
    """(by, start, end, kind): disjoint spans and the gaps between, before and after them, which tile [0, total).

    The totals stand after the spans as places to reach, so spans are read once, in one window. Null keys are one group.
    """
    placed = spans.select(*by, F.col(start).alias("start"), F.col(end).alias("end"), F.lit(False).alias("last_"))
    rows = placed.union(totals.select(*by, F.col(total).alias("start"), F.lit(None).cast(placed.schema["end"].dataType).alias("end"), F.lit(True).alias("last_")))
    order = Window.partitionBy(*by).orderBy("last_", "start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("from_", F.coalesce(F.when(F.col("last_"), reach).otherwise(F.lag("end").over(order)), F.lit(0)))
    piece = lambda a, b, kind: F.struct(F.col(a).alias("start"), F.col(b).alias("end"), F.lit(kind).alias("kind"))
    pieces = F.array(F.when(F.col("from_") < F.col("start"), piece("from_", "start", "gap")), F.when(~F.col("last_"), piece("start", "end", "span")))
    return rows.select(*by, F.explode(pieces).alias("x")).where("x IS NOT NULL").select(*by, "x.start", "x.end", "x.kind")


def runs(rows: DataFrame, by: list[str], order: str, value: Column) -> DataFrame:
    """Islands: (by, run_no, value, first, last, n) of maximal runs of one value, in the order given."""
    w = Window.partitionBy(*by).orderBy("at_")
    rows = rows.select(*by, F.col(order).alias("at_"), value.alias("value"))
    goes_on = F.lag("at_").over(w).isNotNull() & F.lag("value").over(w).eqNullSafe(F.col("value"))
    marked = rows.withColumn("new_", F.when(goes_on, 0).otherwise(1))
    numbered = marked.withColumn("run_no", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "run_no", "value").agg(F.min("at_").alias("first"), F.max("at_").alias("last"), F.count("*").alias("n"))


def backward_steps(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value is below the greatest before them."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("greatest_before", F.max(value).over(w)).where(F.col(value) < F.col("greatest_before"))


def spans_of(points: DataFrame, spans: DataFrame, by: list[str], at: str, default: str, most: int = 1000) -> DataFrame:
    """Each point's `split` of the first listed span (ord) with start_incl <= at < end_excl (null: without end), else
    the default. `spans` is a rule table of at most `most` rows, which become one expression: no row is joined or grouped."""
    rules = spans.orderBy("ord").limit(most + 1).collect()
    if len(rules) > most:
        raise ValueError(f"more than {most} spans: join them instead")
    found = F.lit(default)
    for r in reversed(rules):
        test = F.col(at) >= r["start_incl"]
        if r["end_excl"] is not None:
            test = test & (F.col(at) < r["end_excl"])
        for c in by:
            test = test & F.col(c).eqNullSafe(F.lit(r[c]))
        found = F.when(test, r["split"]).otherwise(found)
    return points.withColumn("split", found)
