"""Quotations with nesting, and splitting outside them: scans of one text, as Arrow-batched functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as t

#: Marks that open and close.
OPENING, CLOSING = "「『〈《", "」』〉》"
SPANS = t.ArrayType(t.StructType([t.StructField("start", t.LongType()), t.StructField("end_excl", t.LongType()), t.StructField("depth", t.LongType())]))


def quotations(text: str | None, opening: str = OPENING[:2], closing: str = CLOSING[:2]) -> list[tuple[int, int, int]]:
    """(start, end, depth) of each quotation with its marks, by start; a mark that closes nothing, or is never closed, is text.
    depth 1 is outermost."""
    waiting, found = [], []
    for i, c in enumerate(text or ""):
        if c in opening:
            waiting.append(i)
        elif c in closing and waiting:
            found.append((waiting.pop(), i + 1))
    found.sort()
    inside: list[int] = []  # ends of the quotations around the one in hand
    spans = []
    for start, end in found:
        inside = [e for e in inside if e > start]
        inside.append(end)
        spans.append((start, end, len(inside)))
    return spans


def pieces(text: str | None, separator: str) -> list[tuple[int, int]]:
    """(start, end) of what stands between separators that no mark encloses; empty pieces are left out."""
    depth, start, found = 0, 0, []
    for i, c in enumerate(text or ""):
        depth = max(0, depth + (c in OPENING) - (c in CLOSING))
        if c == separator and not depth:
            found.append((start, i))
            start = i + 1
    return [(a, b) for a, b in [*found, (start, len(text or ""))] if a < b]


@F.pandas_udf(SPANS)
def quotation_spans(text: pd.Series) -> pd.Series:
    return text.map(lambda x: [{"start": a, "end_excl": b, "depth": d} for a, b, d in quotations(x)])


def split_outside(separator: str):
    @F.pandas_udf(t.ArrayType(t.StringType()))
    def split(text: pd.Series) -> pd.Series:
        return text.map(lambda x: [x[a:b] for a, b in pieces(x, separator)])

    return split
