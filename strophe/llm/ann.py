"""Approximate nearest neighbours by cross-polytope hashing with fast Hadamard pseudo-rotations and multiprobe tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, table
from .grid import lengths, matrix, met_in_blocks, once, side, units, valid

TABLES = 3
RECALL = 0.95  # asked for in the exact answers of ASKED queries, so that 0.9 of all is met
ASKED = 256  # queries, by hash of their id, that are compared with all rows to set the depth of probing
TOGETHER = 256  # queries whose scores are held at once


class Hash(NamedTuple):
    """Cross-polytope tables of two functions each. signs: of the three diagonal matrices (table, function, 3, power of two).

    A cell of a table is a pair of signed axes, one of each function's; an axis is 2 * number, plus 1 if negative. A cell
    is the deeper for a vector, the further its axes are behind the nearest ones: see gaps().
    """

    signs: np.ndarray
    parts: int  # of the axes of a function: a region is a pair of parts
    depth: float = np.inf  # a query probes all cells that aren't deeper

    @classmethod
    def make(cls, dim: int, rows: int = 0, tables: int = TABLES, seed: int = 7) -> Hash:
        size = 1 << max(1, (dim - 1).bit_length())
        return cls(np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 2, 3, size)), side(rows, 2 * size))

    @property
    def regions(self) -> int:
        return self.parts * self.parts

    def rotated(self, x: np.ndarray, t: int, f: int) -> np.ndarray:
        """H D3 H D2 H D1 x, with H the Walsh-Hadamard transform; each step keeps lengths."""
        size = self.signs.shape[3]
        y = np.zeros((len(x), size))
        y[:, : x.shape[1]] = x
        for d in self.signs[t, f]:
            y = y * d
            h = 1
            while h < size:
                y = y.reshape(len(x), -1, 2, h)
                y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2)
                h *= 2
            y = y.reshape(len(x), size) / np.sqrt(size)
        return y

    def axes(self, x: np.ndarray, t: int, f: int) -> np.ndarray:
        """The nearest signed axis of each row."""
        y = self.rotated(x, t, f)
        i = np.abs(y).argmax(axis=1)
        return 2 * i + (y[np.arange(len(y)), i] < 0)

    def gaps(self, x: np.ndarray, t: int, f: int) -> np.ndarray:
        """How far each signed axis is behind the nearest one of each row."""
        y = self.rotated(x, t, f)
        both = np.stack([y, -y], axis=2).reshape(len(y), -1)
        return both.max(axis=1, keepdims=True) - both

    def part(self, axes: np.ndarray) -> np.ndarray:
        return axes * self.parts // (2 * self.signs.shape[3])

    def visited(self, x: np.ndarray, t: int) -> np.ndarray:
        """Whether each region of a table holds a cell that each row probes."""
        starts = np.unique(self.part(np.arange(2 * self.signs.shape[3])), return_index=True)[1]
        a, b = (np.minimum.reduceat(self.gaps(x, t, f), starts, axis=1) for f in (0, 1))
        return (a[:, :, None] + b[:, None, :]).reshape(len(x), -1) <= self.depth


def best(k: int, scores: np.ndarray, y: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k largest of each row of scores = y @ x.T, ties to the smaller of ids; -inf isn't taken.

    The product picks the candidates, with slack for its rounding; order and scores are those of each pair's own sum.
    """
    near = scores > -np.inf
    if len(ids) > k:
        slack = 1e-12 * np.sqrt((y * y).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max(initial=0))
        near &= scores >= (np.partition(scores, -k, axis=1)[:, -k] - slack)[:, None]
    i, j = np.nonzero(near)
    exact = np.einsum("ij,ij->i", y[i], x[j])
    order = np.lexsort([ids[j], -exact, i])
    i, j, exact = i[order], j[order], exact[order]
    first = np.searchsorted(i, i)
    keep = np.arange(len(i)) - first < k
    return i[keep], j[keep], exact[keep]


def depth_of(known: DataFrame, few: list, h: Hash, k: int, recall: float) -> float:
    """The depth of probing that finds `recall` of the k nearest of the few queries (id, v) among all rows.

    Each task keeps the k best that it has read for each of them, and the depth of their cells.
    """
    sent = known.sparkSession.sparkContext.broadcast((np.array([r.id for r in few]), np.array([r.v for r in few], dtype=float), h))
    out = pa.schema([("q", pa.int64()), ("score", pa.float64()), ("depth", pa.float64())])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y, h = sent.value
        asked = units(y)
        gaps = [[h.gaps(asked, t, f) for f in (0, 1)] for t in range(len(h.signs))]
        score, depth = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.inf)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                x, own = matrix(b.column(1)), b.column(0).to_numpy()
                s = y @ x.T
                s[ids[:, None] == own[None, :]] = -np.inf
                top = np.argpartition(-s, k - 1, axis=1)[:, :k] if s.shape[1] > k else np.broadcast_to(np.arange(s.shape[1]), s.shape)
                named, place = np.unique(top, return_inverse=True)
                place, unit, d = place.reshape(top.shape), units(x[named]), np.full(top.shape, np.inf)
                for t, (a, c) in enumerate(gaps):
                    d = np.minimum(d, np.take_along_axis(a, h.axes(unit, t, 0)[place], 1) + np.take_along_axis(c, h.axes(unit, t, 1)[place], 1))
                score, depth = np.concatenate([score, np.take_along_axis(s, top, 1)], 1), np.concatenate([depth, d], 1)
                first = np.argpartition(-score, k - 1, axis=1)[:, :k]
                score, depth = np.take_along_axis(score, first, 1), np.take_along_axis(depth, first, 1)
        q, c = np.nonzero(score > -np.inf)
        yield batch(out, [q, score[q, c], depth[q, c]])

    near = Window.partitionBy("q").orderBy(F.desc("score"), "depth")
    found = known.mapInArrow(measured, "q long, score double, depth double").withColumn("r", F.row_number().over(near)).where(F.col("r") <= k).select("depth").collect()  # at most ASKED * k rows
    return float(np.quantile([r.depth for r in found], recall, method="higher")) + 1e-9 if found else np.inf


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found of each query by inner product of the original vectors: query_id, rank, vec_id, score.

    `queries` holds rows of `vectors`, whose own row is no candidate. Every row is hashed into each table: its cell is the
    pair of signed axes nearest to its direction after two pseudo-rotations. A query probes all cells whose axes aren't further
    behind its nearest ones than a depth, for which ASKED queries are compared with all rows: it finds `recall` of their
    answers. Cells make regions; a row is sent to one region of each table, a query to those in which it probes a cell, and
    of what stands in its cells each region gives its k best. Scores are exact; ties go to the smaller id.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids; rows that repeat an
    id count once, by their smallest vector; vectors of each length are an index of their own; an empty table, or no query,
    gives no rows; other columns, whatever their names, aren't looked at.
    """
    known, asked = (once(valid(df, id_col, vector_col)) for df in (vectors, queries))
    found = [_nearest(known.where(F.size("v") == d), asked.where(F.size("v") == d), d, k, recall) for d in lengths(known)]
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _nearest(known: DataFrame, asked: DataFrame, dim: int, k: int, recall: float) -> DataFrame:
    """nearest() for vectors (id, v) of one length."""
    h = Hash.make(dim, known.count())
    few = asked.orderBy(F.xxhash64("id"), "id").limit(ASKED).collect()
    h = h._replace(depth=depth_of(known, few, h, k, recall) if few else np.inf)
    sent = known.sparkSession.sparkContext.broadcast(h)
    tables, of = len(h.signs), h.regions
    kind = known.schema["v"].dataType.simpleString()

    def placed(x: np.ndarray, t: int, h: Hash, probing: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows with the regions that they are sent to, and their cells."""
        a, b = (h.axes(x, t, f) for f in (0, 1))
        if probing:
            row, region = np.nonzero(h.visited(x, t))
        else:
            row, region = np.arange(len(x)), h.part(a) * h.parts + h.part(b)
        return row, t * of + region, (a << 20 | b)[row]

    def dealt(probing: bool):
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = units(matrix(b.column(1)))
                    for t in range(tables):
                        row, region, cell = placed(x, t, sent.value, probing)
                        rows = pa.array(row)
                        yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(region), pa.array(cell)], names=["id", "v", "region", "cell"])

        return deal

    def counted(probing: bool):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, int] = {}
            for b in batches:
                if b.num_rows:
                    x = units(matrix(b.column(1)))
                    for t in range(tables):
                        for r, n in zip(*np.unique(placed(x, t, sent.value, probing)[1], return_counts=True)):
                            total[int(r)] = total.get(int(r), 0) + int(n)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["region", "n"])

        return count

    count = lambda df, probing, name: df.mapInArrow(counted(probing), "region long, n long").groupBy("region").agg(F.sum("n").alias(name))
    counts = count(known, False, "rows").join(count(asked, True, "probes"), "region")
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def met(probes: pa.Table, rows: pa.Table) -> pa.Table:
        found = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        if probes.num_rows and rows.num_rows:
            h = sent.value
            t = probes.column("region")[0].as_py() // of
            ids, x, cell = rows.column("id").to_numpy(), matrix(rows.column("v")), rows.column("cell").to_numpy()
            a, b = cell >> 20, cell & (1 << 20) - 1
            for at in range(0, probes.num_rows, TOGETHER):
                some = probes.slice(at, TOGETHER)
                asked, y = some.column("id").to_numpy(), matrix(some.column("v"))
                unit = units(y)
                reached = h.gaps(unit, t, 0)[:, a] + h.gaps(unit, t, 1)[:, b] <= h.depth
                scores = np.where(reached & (asked[:, None] != ids[None, :]), y @ x.T, -np.inf)
                i, j, exact = best(k, scores, y, ids, x)
                for f, own in zip(found, (asked[i], ids[j], exact)):
                    f.append(own)
        return pa.table([np.concatenate(f) for f in found], schema=out)

    kinds = f"id long, v {kind}, region long, cell long"
    pairs = met_in_blocks(known.mapInArrow(dealt(False), kinds), asked.mapInArrow(dealt(True), kinds), met, "query_id long, vec_id long, score double", counts)
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    single = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return single.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
