"""Structured Streaming forms: windows and sessions under a watermark, last record per key, running budgets."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, late: str = "10 minutes", wide: str = "1 hour", slide: str | None = None, at: str = "ts", by: str = "event_type") -> DataFrame:
    """(start, end, by, n, total) per window; events later than the watermark are left out in a stream."""
    window = F.window(at, wide, slide) if slide else F.window(at, wide)
    counts = events.withWatermark(at, late).groupBy(window, by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes", at: str = "ts", by: str = "user_id") -> DataFrame:
    """(start, end, by, n) per session: events less than `gap` apart."""
    counts = events.withWatermark(at, late).groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("n"))
    return counts.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def once(events: DataFrame, key: list[str], late: str = "1 hour", at: str = "ts") -> DataFrame:
    """The first event of each key within the watermark: an answer that arrives again isn't taken again."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def last_of_key(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Update-mode table of the last record of each key: (key, order, value). Works on batches too."""
    return events.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order)).select(key, order, value)


def running_budget(events: DataFrame, key: str, amount: str, budget: float) -> DataFrame:
    """(key, total, over): the running total of each key and whether it has passed the budget, in update mode."""

    def step(k: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        total = state.get[0] if state.exists else 0.0
        for pdf in frames:
            total += float(pdf[amount].fillna(0).sum())
        state.update((total,))
        yield pd.DataFrame([{key: k[0], "total": total, "over": total > budget}])

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, total double, over boolean", "total double", "update", GroupStateTimeout.NoTimeout)
