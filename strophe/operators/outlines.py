"""Outline trees against texts and one another: inherited starts, tiled ends, admissible ranges, chains, and what a scorer counts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import table
from .tree import walked


def span_starts(nodes: DataFrame, first_line: int | None = None) -> DataFrame:
    """(tree, id, span_start, inherited): a first child starts where its parent does, any other node where it is explained.

    nodes: (tree, id, parent, ord, explained, editorial). Nothing is inherited from an editorial parent, nor a start before
    `first_line`, where the text in hand begins.
    """
    first = F.row_number().over(Window.partitionBy("tree", "parent").orderBy("ord", "id")) == 1
    base = nodes.withColumn("first_", first & F.col("parent").isNotNull())
    fits = lambda a: a["start"].isNotNull() & ~a["editorial"] & (F.lit(True) if first_line is None else a["start"] >= first_line)

    def step(a: Column) -> Column:
        takes = F.col("first_") & F.coalesce(fits(a), F.lit(False))
        return F.struct(F.when(takes, a["start"]).otherwise(F.col("explained")).alias("start"), F.col("editorial").alias("editorial"), takes.alias("inherited"))

    seed = F.struct(F.col("explained").alias("start"), F.col("editorial").alias("editorial"), F.lit(False).alias("inherited"))
    return walked(base, seed, step).select("tree", "id", F.col("state.start").alias("span_start"), F.col("state.inherited").alias("inherited"))


def scored_parents(nodes: DataFrame, key: Column) -> DataFrame:
    """(tree, id, parent) of the nodes with a key, each under its nearest ancestor that has one; null under none."""
    own = F.when(key.isNotNull(), F.col("id"))
    seed = F.struct(own.alias("last"), F.lit(None).cast("string").alias("above"))
    found = walked(nodes, seed, lambda a: F.struct(F.coalesce(own, a["last"]).alias("last"), a["last"].alias("above")))
    return found.where(key.isNotNull()).select("tree", "id", F.col("state.above").alias("parent"))


def by_level_up(nodes: DataFrame, marked: Column, least: int = 2) -> DataFrame:
    """(tree, id, marked) where a node is marked itself, or all its children are and they are `least` at least; innermost first.

    One aggregate and one join a level, from the deepest up. nodes: (tree, id, parent, level).
    """
    state = table(nodes.select("tree", "id", "parent", "level", F.coalesce(marked, F.lit(False)).alias("marked")), "marked")
    deepest = state.agg(F.max("level")).head()[0] or 0
    for level in range(deepest - 1, 0, -1):
        kids = state.where(F.col("level") == level + 1).groupBy("tree", F.col("parent").alias("id")).agg(F.every("marked").alias("all_"), F.count("*").alias("n_"))
        above = state.where(F.col("level") == level).join(kids, ["tree", "id"], "left")
        above = above.select("tree", "id", "parent", "level", (F.col("marked") | F.coalesce(F.col("all_") & (F.col("n_") >= least), F.lit(False))).alias("marked"))
        state = table(state.where(F.col("level") != level).unionByName(above), "marked")
    return state.select("tree", "id", "marked")


def tiled_ends(nodes: DataFrame, last: Column) -> DataFrame:
    """(tree, id, end, clamped): a node ends on the line before its next sibling's start, the last child where its parent ends,
    a root's last child at `last`; never before its own start, nor after its parent's end.

    nodes: (tree, id, parent, ord, start); nodes without a start are left out, with all below them.
    """
    following = F.lead("start").over(Window.partitionBy("tree", "parent").orderBy("ord", "id"))
    base = nodes.where("start IS NOT NULL").withColumn("next_", following - 1)

    def end(limit: Column) -> Column:
        tiled = F.coalesce("next_", limit)
        kept = F.when(tiled < F.col("start"), F.col("start")).when(tiled > limit, limit).otherwise(tiled)
        return F.struct(kept.alias("end"), (kept != tiled).alias("clamped"))

    return walked(base, end(last), lambda a: end(a["end"])).select("tree", "id", F.col("state.end").alias("end"), F.col("state.clamped").alias("clamped"))


def admissible(nodes: DataFrame, top: int) -> DataFrame:
    """(tree, id, lo, hi): where a span of the node may lie: inside all ancestors' spans, not before an elder sibling's end nor
    after the next younger sibling's start. nodes: (tree, id, parent, ord, start, end), null without a span; a null end is the start.

    What comes after is read backwards: a frame that ends at the last row is computed anew for each row of a family.
    """
    w = Window.partitionBy("tree", "parent").orderBy("ord", "id")
    back = Window.partitionBy("tree", "parent").orderBy(F.desc("ord"), F.desc("id"))
    reach = F.coalesce("end", "start")
    base = nodes.withColumns({
        "elder_": F.max(F.when(F.col("start").isNotNull(), reach)).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "younger_": F.last("start", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)),
    })
    bounds = lambda lo, hi: F.struct(lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))
    within = lambda a: bounds(F.greatest(a["lo"], "start"), F.least(a["hi"], F.when(F.col("start").isNotNull(), F.col("end"))))
    open_ = bounds(F.lit(0), F.lit(top))
    found = walked(base, F.struct(open_.alias("own"), within(open_).alias("below")), lambda a: F.struct(a["below"].alias("own"), within(a["below"]).alias("below")))
    return found.select("tree", "id", F.greatest(F.col("state.own.lo"), "elder_").alias("lo"), F.least(F.col("state.own.hi"), "younger_").alias("hi"))


#: A tree of at most so many nodes is read whole in one task; levels below DEEPEST are an error.
WHOLE, DEEPEST = 10_000, 64


def chain_lengths(ids: list, parents: list, deepest: int) -> dict | None:
    """The length of the chain that each head begins, of one tree's nodes; None if a level lies below `deepest` or an id is null or repeated."""
    if None in ids or len(set(ids)) < len(ids):
        return None
    kids: dict = {}
    for i, p in zip(ids, parents):
        if p is not None:
            kids.setdefault(p, []).append(i)
    level, lengths = [(i, i, 1) for i, p in zip(ids, parents) if p is None], {}
    for _ in range(deepest):
        below = []
        for i, head, at in level:
            own = kids.get(i, ())
            if len(own) == 1:
                below.append((own[0], head, at + 1))
            else:
                lengths[head] = at
                below.extend((k, k, 1) for k in own)
        level = below
    return None if level else lengths


def single_chains(nodes: DataFrame) -> DataFrame:
    """(tree, id, length): how many nodes hang on one another from here down, each the only child of the one before.

    Trees of at most WHOLE nodes are each read whole, so their nodes are shuffled once, however deep they are; what is left (larger
    trees, null or repeated ids) is walked level by level.
    """
    kind = {c: nodes.schema[c].dataType.simpleString() for c in ("tree", "id")}
    rows = nodes.select("tree", "id", F.col("parent").cast(kind["id"]).alias("parent")).repartition("tree").sortWithinPartitions("tree")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        types = None

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["tree", "id", "parent", "length"])
            out.clear()
            return made

        def close() -> None:
            found = chain_lengths(ids, parents, DEEPEST) if tree is not None and not large else None
            out.extend(((tree, i, None, n) for i, n in found.items()) if found is not None else ((tree, i, p, None) for i, p in zip(ids, parents)))
            ids.clear()
            parents.clear()

        tree, ids, parents, large = None, [], [], False
        for b in batches:
            types = [*b.schema.types, pa.int64()]
            for t, i, p in zip(*(c.to_pylist() for c in b.columns)):
                if t != tree:
                    close()
                    tree, large = t, False
                ids.append(i)
                parents.append(p)
                if len(ids) > WHOLE:
                    large = True
                    close()
                if len(out) >= WHOLE:
                    yield batch()
        close()
        if out:
            yield batch()

    done = table(rows.mapInArrow(whole, f"tree {kind['tree']}, id {kind['id']}, parent {kind['id']}, length long"), "chains")
    found, left = done.where("length IS NOT NULL").select("tree", "id", "length"), done.where("length IS NULL").drop("length")
    return found if left.isEmpty() else found.unionByName(walked_chains(left))


def walked_chains(nodes: DataFrame) -> DataFrame:
    """single_chains(), level by level."""
    kids = nodes.where("parent IS NOT NULL").groupBy("tree", F.col("parent").alias("id")).agg(F.count("*").alias("kids_"))
    base = nodes.join(kids, ["tree", "id"], "left").withColumn("single_", F.coalesce(F.col("kids_") == 1, F.lit(False)))
    seed = F.struct(F.col("id").alias("head"), F.lit(1).cast("bigint").alias("at"), F.col("single_").alias("goes"))
    step = lambda a: F.struct(F.when(a["goes"], a["head"]).otherwise(F.col("id")).alias("head"), F.when(a["goes"], a["at"] + 1).otherwise(1).alias("at"), F.col("single_").alias("goes"))
    return walked(base, seed, step, DEEPEST).groupBy("tree", F.col("state.head").alias("id")).agg(F.max("state.at").alias("length"))


def least_below(tree: DataFrame, value: str) -> DataFrame:
    """(tree, id, least, most): the extremes of `value` in each subtree of numbered() rows; each node is counted at its ancestors."""
    up = tree.select("tree", value, F.explode(F.expr("transform(sequence(1, size(split(path, '[.]'))), k -> array_join(slice(split(path, '[.]'), 1, k), '.'))")).alias("path"))
    sums = up.groupBy("tree", "path").agg(F.min(value).alias("least"), F.max(value).alias("most"))
    return tree.select("tree", "path", "id").join(sums, ["tree", "path"]).select("tree", "id", "least", "most")


def missed(gold: DataFrame, matched: DataFrame, free: DataFrame, tolerance: int = 0) -> DataFrame:
    """(tree, id, kind) of gold nodes (tree, id, parent, line) that aren't matched (tree, gold_id): cascaded under a parent that is
    missed too, else frontier, or frontier_detected if a free predicted line (tree, line) is near."""
    hit = matched.select("tree", F.col("gold_id").alias("id"), F.lit(True).alias("hit"))
    up = matched.select("tree", F.col("gold_id").alias("parent"), F.lit(True).alias("parent_hit"))
    lost = gold.join(hit, ["tree", "id"], "left").where("hit IS NULL").join(up, ["tree", "parent"], "left")
    near = F.explode(F.sequence(F.col("line") - tolerance, F.col("line") + tolerance))
    lines = free.select("tree", near.alias("line")).distinct().withColumn("seen", F.lit(True))
    frontier = F.col("parent").isNull() | F.col("parent_hit").isNotNull()
    return lost.join(lines, ["tree", "line"], "left").select("tree", "id", F.when(~frontier, "cascaded").when(F.col("seen"), "frontier_detected").otherwise("frontier").alias("kind"))


def child_counts(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Announced counts of matched pairs (by, gold_count, pred_count, mismatch): how many are right, the source's own
    disagreements left out of the accuracy's denominator."""
    known, said = F.col("gold_count").isNotNull(), F.col("pred_count").isNotNull()
    wrong = known & said & (F.col("gold_count") != F.col("pred_count"))
    flag = F.coalesce("mismatch", F.lit(False))
    tests = {"eligible": known, "correct": known & (F.col("gold_count") == F.col("pred_count")), "wrong": wrong & ~flag, "missing": known & ~said, "source_disagreements": wrong & flag, "at_count_mismatch": known & flag, "pred_only": ~known & said}
    sums = pairs.groupBy(*by).agg(*(F.count_if(F.coalesce(test, F.lit(False))).alias(name) for name, test in tests.items()))
    return sums.withColumn("accuracy", F.round(F.try_divide(F.col("correct").cast("double"), (F.col("eligible") - F.col("source_disagreements")).cast("double")), 6))


def depth_offsets(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, pairs, mode, share_at_mode, share_within_1) of pairs (by, pred_level, gold_level); of equally frequent offsets the
    smaller in size, then the smaller, is the mode."""
    hist = pairs.groupBy(*by, (F.col("pred_level") - F.col("gold_level")).alias("offset")).agg(F.count("*").alias("n"))
    mode = F.min_by("offset", F.struct(-F.col("n"), F.abs("offset"), F.col("offset"))).alias("mode")
    tops = hist.groupBy(*by).agg(F.sum("n").alias("pairs"), mode)
    share = lambda test: F.round(F.sum(F.when(test, F.col("n")).otherwise(0)) / F.first("pairs"), 6)
    away = F.abs(F.col("offset") - F.col("mode"))
    return hist.join(tops, by).groupBy(*by).agg(F.first("pairs").alias("pairs"), F.first("mode").alias("mode"), share(away == 0).alias("share_at_mode"), share(away <= 1).alias("share_within_1"))


def deepest_ancestors(placements: DataFrame, nodes: DataFrame, qualifies: Column) -> DataFrame:
    """placements (tree, id, ...) with `attached`: the nearest node at or above theirs that qualifies; null without one."""
    own = F.when(qualifies, F.col("id"))
    state = walked(nodes, own, lambda a: F.coalesce(own, a)).select("tree", "id", F.col("state").alias("attached"))
    return placements.join(state, ["tree", "id"], "left")
