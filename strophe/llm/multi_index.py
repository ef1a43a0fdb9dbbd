"""Embedding near-duplicates by an inverted multi-index: codebooks on the two halves form a grid of cells."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, sized, table
from .components import components
from .grid import lengths, matrix, met_in_blocks, once, side, units, valid

SAMPLE = 8192  # vectors on which codebooks are fitted and the first depth of the traversal is set, and PER_CENTROID at least
PER_CENTROID = 16
ASKED = 1024  # vectors whose real links may deepen it
PAIRS = 20_000  # whose depths are measured in 2,048 rows; of more, a random choice that stands for all
PER_CELL = 64  # vectors that a cell holds on average
RECALL = 0.98


class Index(NamedTuple):
    """A codebook for each half; neighbours in a codebook are near one another, as far as one axis can tell."""

    left: np.ndarray
    right: np.ndarray
    cells: int  # how many cells the traversal visits
    parts: int = 1  # of each codebook: a region is a pair of parts

    def region(self, cell: Column) -> Column:
        part = lambda i, codebook: F.floor(i * self.parts / len(codebook))
        return (part(F.floor(cell / len(self.right)), self.left) * self.parts + part(cell % len(self.right), self.right)).cast("int")

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.left.shape[1]
        return squared(x[:, :half], self.left), squared(x[:, half:], self.right)

    def visited(self, x: np.ndarray, cells: int | None = None) -> np.ndarray:
        """Numbers of the cells nearest to each row, nearest first: see traversal()."""
        a, b = self.distances(x)
        return traversal(a, b, self.cells if cells is None else cells)


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :])


def traversal(a: np.ndarray, b: np.ndarray, cells: int) -> np.ndarray:
    """Multi-sequence traversal: the `cells` pairs (i, j) of least a[i] + b[j] per row, in that order, as i * columns + j.

    Of pairs in order, the one at ranks (r, s) has (r + 1)(s + 1) - 1 before it, so only ranks with
    (r + 1)(s + 1) <= cells can be among the first; these are summed and sorted for all rows at once.
    """
    oa, ob = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
    r, s = np.array([(r, s) for r in range(min(cells, a.shape[1])) for s in range(min(cells // (r + 1), b.shape[1]))]).T
    total = np.take_along_axis(a, oa, 1)[:, r] + np.take_along_axis(b, ob, 1)[:, s]
    first = np.argsort(total, axis=1, kind="stable")[:, :cells]
    return np.take_along_axis(oa, r[first], 1) * b.shape[1] + np.take_along_axis(ob, s[first], 1)


def centroids(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means, a dozen rounds; a centroid that loses all its vectors stays. In the order of their first principal component."""
    if not x.shape[1]:  # the left half of vectors of one component
        return np.zeros((1, 0))
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(12):
        near = squared(x, centres).argmin(axis=1)
        n = np.bincount(near, minlength=len(centres))
        for d in range(x.shape[1]):
            sums = np.bincount(near, weights=x[:, d], minlength=len(centres))
            centres[n > 0, d] = sums[n > 0] / n[n > 0]
    away = centres - centres.mean(axis=0)
    return centres[np.argsort(away @ np.linalg.svd(away, full_matrices=False)[2][0], kind="stable")]


def codebook_size(total: int) -> int:
    return max(2, int(np.sqrt(total / PER_CELL)))


def build(sample: np.ndarray, total: int, cosine: float, recall: float = RECALL, seed: int = 11) -> Index:
    """Codebooks for `total` unit vectors, and how many cells must be visited.

    The traversal is as deep as the share `recall` of partners needs that lie at exactly `cosine` from the sample's
    vectors, in random directions. Real links may need more: see deepened().
    """
    rng = np.random.default_rng(seed)
    half = sample.shape[1] // 2
    k = codebook_size(total)
    index = Index(centroids(sample[:, :half], k, rng), centroids(sample[:, half:], k, rng), 1)
    index = index._replace(parts=side(total, min(len(index.left), len(index.right))))
    if sample.shape[1] == 1:  # there is no direction but forward and back
        return index
    some = sample[:1024]
    away = rng.standard_normal(some.shape)
    away -= (away * some).sum(axis=1, keepdims=True) * some
    partner = cosine * some + np.sqrt(1 - cosine * cosine) * units(away)
    a, b = index.distances(some)
    pa_, pb = (d.argmin(axis=1) for d in index.distances(partner))
    rows = np.arange(len(some))
    there = a[rows, pa_] + b[rows, pb]
    depth = np.array([(a[i][:, None] + b[i][None, :] < there[i]).sum() for i in rows]) + 1
    return index._replace(cells=int(np.quantile(depth, recall, method="higher")))


def depths(a: np.ndarray, b: np.ndarray, there: np.ndarray) -> np.ndarray:
    """How many cells of each row are nearer than `there`, and one more."""
    b = np.sort(b, axis=1)
    return np.array([np.searchsorted(y, t - x).sum() for x, y, t in zip(a, b, there)], dtype=np.int64) + 1


def deepened(index: Index, classes: DataFrame, ids: np.ndarray, asked: np.ndarray, cosine: float, recall: float) -> Index:
    """The index, its traversal no shallower than the share `recall` of the real links of the asked needs.

    The asked (ids, unit vectors) are compared with all of classes (rep, v); of a link, the end that is sooner at the
    other's cell counts.
    """
    sent = classes.sparkSession.sparkContext.broadcast((index, ids, asked))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids, asked = sent.value
        qa, qb = index.distances(asked)
        qi, qj = qa.argmin(axis=1), qb.argmin(axis=1)
        rng = np.random.default_rng(5)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                x = units(matrix(b.column(1)))
                row, q = np.nonzero((x @ asked.T >= cosine) & (b.column(0).to_numpy()[:, None] != ids[None, :]))
                if not len(row):
                    continue
                stands = max(1.0, len(row) / PAIRS)
                if stands > 1:
                    some = rng.choice(len(row), PAIRS, replace=False)
                    row, q = row[some], q[some]
                xa, xb = index.distances(x)
                xi, xj = xa.argmin(axis=1), xb.argmin(axis=1)
                there = depths(xa[row], xb[row], xa[row, qi[q]] + xb[row, qj[q]])
                back = depths(qa[q], qb[q], qa[q, xi[row]] + qb[q, xj[row]])
                depth, n = np.unique(np.minimum(there, back), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(depth), pa.array(n * stands)], names=["depth", "n"])

    found = classes.select("rep", "v").mapInArrow(measured, "depth long, n double").groupBy("depth").agg(F.sum("n").alias("n")).orderBy("depth").collect()  # at most 65,536 rows
    if not found:
        return index
    n = np.cumsum([r.n for r in found])
    deep = found[min(int(np.searchsorted(n, recall * n[-1])), len(found) - 1)].depth
    return index._replace(cells=min(max(index.cells, deep), len(index.left) * len(index.right)))


def linked(classes: DataFrame, index: Index, cosine: float) -> DataFrame:
    """(id, n, link): of vectors (rep, v, copies) that have links in some block, how many, and a vector linked to them there.

    A vector is a member of its own cell and probes the cells that it visits. A pair is found if either visits the
    other's cell, and counted once at each end: at the member's end only where it won't find the pair as a probe. Cells make
    regions: a vector is sent as a member to one, and as a probe once to each in which it visits a cell.
    """
    sent = classes.sparkSession.sparkContext.broadcast(index)
    kind = classes.schema["v"].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                x = units(matrix(b.column(1)))
                cells = index.visited(x)
                a, c = index.distances(x)
                home = a.argmin(axis=1) * len(index.right) + c.argmin(axis=1)
                lists = pa.ListArray.from_arrays(np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32), pa.array(cells.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(home.astype(np.int32)), lists], names=["id", "v", "copies", "home", "visits"])

    rows = table(classes.select("rep", "v", "copies").mapInArrow(placed, f"id long, v {kind}, copies long, home int, visits array<int>"), "placed")
    members = rows.select("id", "v", "copies", "visits", "home", index.region(F.col("home")).alias("region"))
    regions = F.array_distinct(F.transform("visits", index.region))
    probes = rows.select("id", "v", "copies", "home", "visits", F.explode(regions).alias("region")).withColumn("visits", F.filter("visits", lambda c: index.region(c) == F.col("region")))
    count = lambda df, name: df.groupBy("region").agg(F.count("*").alias(name))
    counts = count(rows.select(index.region(F.col("home")).alias("region")), "rows").join(count(rows.select(F.explode(regions).alias("region")), "probes"), "region")

    def met(probes: pa.Table, members: pa.Table) -> pa.Table:
        out = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("link", pa.int64())])
        if not probes.num_rows or not members.num_rows:
            return out.empty_table()
        pid, mid = (t.column("id").to_numpy() for t in (probes, members))
        x, y = units(matrix(probes.column("v"))), units(matrix(members.column("v")))
        pcopies, mcopies = (t.column("copies").to_numpy() for t in (probes, members))
        phome, mhome = (t.column("home").to_numpy() for t in (probes, members))
        visits = members.column("visits").combine_chunks().flatten().to_numpy().reshape(len(mid), -1)
        asked = probes.column("visits").combine_chunks()
        cell, prow = asked.flatten().to_numpy(), np.repeat(np.arange(len(pid)), asked.value_lengths().to_numpy())
        order, morder = np.argsort(cell, kind="stable"), np.argsort(mhome, kind="stable")
        cell, prow, home = cell[order], prow[order], mhome[morder]
        pn, mn = np.zeros(len(pid), np.int64), np.zeros(len(mid), np.int64)
        names, place = np.unique(np.concatenate([pid, mid]), return_inverse=True)
        parent, pairs, held = np.arange(len(names)), [], 0
        pplace, mplace = place[: len(pid)], place[len(pid) :]
        for c in np.intersect1d(cell, home):
            own = morder[np.searchsorted(home, c) : np.searchsorted(home, c, side="right")]
            asking = prow[np.searchsorted(cell, c) : np.searchsorted(cell, c, side="right")]
            for at in range(0, len(asking), 512):
                part = asking[at : at + 512]
                near = x[part] @ y[own].T
                i, j = np.nonzero(near >= cosine - 1e-9)
                if not len(i):
                    continue
                close = np.flatnonzero(near[i, j] < cosine + 1e-9)
                i, j, sure = part[i], own[j], np.ones(len(i), bool)
                sure[close] = np.einsum("ij,ij->i", x[i[close]], y[j[close]]) >= cosine
                sure &= pid[i] != mid[j]
                i, j = i[sure], j[sure]
                np.add.at(pn, i, mcopies[j])
                back = (visits[j] == phome[i][:, None]).any(axis=1)
                np.add.at(mn, j[~back], pcopies[i[~back]])
                pairs.append((pplace[i], mplace[j]))
                held += len(i)
                if held > 500_000:
                    parent, pairs, held = joined(parent, *(np.concatenate(p) for p in zip(*pairs))), [], 0
        if pairs:
            parent = joined(parent, *(np.concatenate(p) for p in zip(*pairs)))
        hang = parent != np.arange(len(names))
        ids = np.concatenate([pid[pn > 0], mid[mn > 0], names[hang]])
        counts = np.concatenate([pn[pn > 0], mn[mn > 0], np.zeros(int(hang.sum()), np.int64)])
        links = pa.array(np.concatenate([pid[pn > 0], mid[mn > 0], names[parent[hang]]]))
        return pa.table([ids, counts, links], schema=out)

    found = table(met_in_blocks(members, probes, met, "id long, n long, link long", counts), "found")
    dropped(rows)
    return found


def joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least labels after links between a and b, by hooking and pointer jumping; a label is the least place reached."""
    while True:
        pa_, pb = parent[a], parent[b]
        high, low = np.maximum(pa_, pb), np.minimum(pa_, pb)
        differ = high != low
        if not differ.any():
            return parent
        np.minimum.at(parent, high[differ], low[differ])
        while (parent[parent] != parent).any():
            parent = parent[parent]


def classes_of(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors (id, v) by direction: (rep, v, copies) of each, and (id, rep, copies) of every vector. Only the hashes of the
    directions are moved, and the vectors that stand for a direction where their number allows no broadcast."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([xxhash.xxh128_digest(u.tobytes()) for u in units(matrix(b.column(1))) + 0.0], pa.binary())], names=["id", "way"])

    ways = table(known.mapInArrow(hashed, "id long, way binary"), "directions")
    several = table(ways.groupBy("way").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "several")
    of = table(ways.join(several, "way").select("id", "rep", "copies"), "copies")
    others = sized(table(of.where("id <> rep").select("id"), "others"))
    first = sized(table(of.where("id = rep").select("id", "copies"), "first"))
    one = F.lit(1).cast("long")
    classes = known.join(others, "id", "left_anti").join(first, "id", "left").select(F.col("id").alias("rep"), "v", F.coalesce("copies", one).alias("copies"))
    each = ways.select("id").join(of, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("copies", one).alias("copies"))
    return classes, each


def near_vectors(vectors: DataFrame, cosine: float = 0.9, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Links join vectors whose cosine, in double precision, is at least `cosine`; component_id is the smallest id that
    links reach. Vectors that are null, zero or hold null or non-finite components link with nothing; so does a null id.
    Vectors of each length are an index of their own. Rows that repeat an id are one vector, the smallest. Equal
    directions are one class: its members are linked with one another and counted, but met with others once. An empty table
    gives no rows; other columns, whatever their names, aren't looked at.
    """
    everything = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    known = once(valid(vectors, id_col, vector_col))
    found = [_near(known.where(F.size("v") == d), cosine, recall) for d in lengths(known)]
    nothing = vectors.sparkSession.createDataFrame([], "vec_id long, n_links long, component long")
    each = reduce(DataFrame.unionByName, found) if found else nothing
    component = F.coalesce("component", "vec_id")
    return everything.join(each, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _near(known: DataFrame, cosine: float, recall: float) -> DataFrame:
    """(vec_id, n_links, component) of vectors (id, v) of one length."""
    classes, each = classes_of(known)
    total = classes.count()
    some = classes.orderBy(F.xxhash64("rep"), "rep").select("rep", "v").limit(max(SAMPLE, PER_CENTROID * codebook_size(total))).collect()
    sample = units(np.array([r.v for r in some], dtype=float))
    index = build(sample, total, cosine, recall)
    index = deepened(index, classes, np.array([r.rep for r in some[:ASKED]]), sample[:ASKED], cosine, recall)
    found = linked(classes, index, cosine)
    counts = found.groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n"))
    label = components(found, "id", "link").select(F.col("id").alias("rep"), "component")
    reps = table(counts.join(label, "rep", "full"), "linked")
    return each.join(reps, "rep", "left").select(F.col("id").alias("vec_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
