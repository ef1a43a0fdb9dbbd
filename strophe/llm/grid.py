"""What the two vector operators share: valid vectors, and regions of an index whose rows meet the probes sent to them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, table

REGION = 16_384  # rows that a region of an index holds on average
LEAST = 4  # regions, however small the table
#: Rows and probes of a region are split into blocks of about so many; each block of rows meets each of probes.
BLOCK = 8192


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part: v has no null or non-finite component and isn't all zero. Arrays of floats
    stay such, all others become doubles, so nothing is rounded."""
    native = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    v = F.col(vector_col) if native else F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)


def once(known: DataFrame) -> DataFrame:
    """valid() rows, of those that repeat an id the one with the smallest vector. Only repeated ids are moved."""
    again = table(known.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")
    if again.isEmpty():
        return known
    again = sized(again)
    return known.join(again, "id", "left_anti").unionByName(known.join(again, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v")))


def lengths(known: DataFrame) -> list[int]:
    """The numbers of components that vectors have: each is an index of its own."""
    return sorted(r.d for r in known.select(F.size("v").alias("d")).distinct().collect())


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow list column as rows of doubles; all have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by way of their largest component so that nothing over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def side(rows: int, most: int) -> int:
    """Of how many parts each of an index' two axes is made, so that regions hold about REGION of so many rows."""
    return int(min(most, np.ceil(np.sqrt(max(LEAST, rows / REGION)))))


def met_in_blocks(rows: DataFrame, probes: DataFrame, met: Callable, schema: str, counts: DataFrame) -> DataFrame:
    """cogroup().applyInArrow(met) of the probes and rows of each region, in blocks, so that no task holds a hot region.

    rows and probes have columns region and id; counts (region, rows, probes) says how many there are.
    """
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int").alias(f"{c}_blocks")
    split = sized(table(counts.where("rows > 0 AND probes > 0").select("region", blocks("rows"), blocks("probes")), "regions"))
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = rows.join(split, "region").withColumn("block", at("rows_blocks")).withColumn("probe_block", every("probes_blocks")).drop("rows_blocks", "probes_blocks")
    probes = probes.join(split, "region").withColumn("probe_block", at("probes_blocks")).withColumn("block", every("rows_blocks")).drop("rows_blocks", "probes_blocks")
    rows = rows.select(*(F.col(c).alias(c) for c in rows.columns))  # both may come from one table
    keys = ["region", "block", "probe_block"]
    return probes.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(met, schema)
