"""Matching a predicted tree with a reference tree, top down, and dynamic programs over sibling sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

PAIRS = "tree string, pred_id string, gold_id string"


def align(near: dict[tuple[int, int], tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs, increasing on both sides, of the allowed ones (with distance and index difference): the most pairs, then
    the least distance, then the least index difference, then the smallest first pair, and so on.

    A weighted chain over the allowed pairs alone: taken from the last row up, each is followed by the best chain that starts in a later
    row and column. `starts` is a Fenwick tree over the columns from the right, so a pair costs a logarithm.
    """
    rows: dict[int, list[int]] = {}
    for i, j in near:
        rows.setdefault(i, []).append(j)
    wide = max((j for _, j in near), default=-1) + 1
    nothing = (0, 0, 0, 0, 0, None)
    starts = [nothing] * (wide + 1)

    def best_after(j: int) -> tuple:
        at, best = wide - 1 - j, nothing
        while at > 0:
            best, at = max(best, starts[at], key=lambda c: c[:5]), at & (at - 1)
        return best

    for i in sorted(rows, reverse=True):
        chains = []
        for j in rows[i]:
            n, distance, apart, _, _, _ = after = best_after(j)
            chains.append((n + 1, distance - near[i, j][0], apart - near[i, j][1], -i, -j, after))
        for chain in chains:
            at = wide + chain[4]
            while at <= wide:
                starts[at], at = max(starts[at], chain, key=lambda c: c[:5]), at + (at & -at)
    chain, pairs = best_after(-1), []
    while chain[5] is not None:
        pairs.append((-chain[3], -chain[4]))
        chain = chain[5]
    return pairs


def match_trees(pred: pd.DataFrame, gold: pd.DataFrame, tolerance: int) -> list[tuple[str, str]]:
    """Children are aligned under matched parents only; a key further than `tolerance` lines, or none, never matches."""
    sides = []
    for nodes in (pred, gold):
        kept = nodes.sort_values(["line", "order"], kind="stable")
        above = kept["parent"].where(kept["parent"].notna(), "")
        sides.append({p: (own["id"].tolist(), own["line"].to_numpy(float)) for p, own in kept.groupby(above, sort=False)})
    found, front = [], [("", "")]
    for above in front:  # grows as pairs are found
        (ids, lines), (gold_ids, gold_lines) = (side.get(p, ([], np.empty(0))) for side, p in zip(sides, above))
        low = np.searchsorted(gold_lines, lines - tolerance)  # nulls are last, and beyond every number
        high = np.searchsorted(gold_lines, lines + tolerance, side="right")
        near = {(i, j): (abs(int(lines[i] - gold_lines[j])), abs(i - j)) for i in range(len(ids)) if lines[i] == lines[i] for j in range(low[i], high[i])}
        new = [(ids[i], gold_ids[j]) for i, j in align(near)]
        found += new
        front += new
    return found


def tree_pairs(pred: DataFrame, gold: DataFrame, tolerance: int = 0) -> DataFrame:
    """(tree, pred_id, gold_id) of two node tables (tree, id, parent, line, order); each tree is one task's work."""

    def both(key, p: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], a, b) for a, b in match_trees(p, g, tolerance)], columns=["tree", "pred_id", "gold_id"])

    cols = ["tree", "id", "parent", "line", "order"]
    own = [F.col(c).alias(c) for c in cols]  # both may come from one table
    return pred.select(*cols).groupBy("tree").cogroup(gold.select(*own).groupBy("tree")).applyInPandas(both, PAIRS)


def tree_scores(pred: DataFrame, gold: DataFrame, tolerance: int = 0) -> DataFrame:
    """(tree, tp, fp, fn, p, r, f) of the nodes."""
    from .measure import precision_recall

    tp = tree_pairs(pred, gold, tolerance).groupBy("tree").agg(F.count("*").alias("tp"))
    count = lambda df, n: df.groupBy("tree").agg(F.count("*").alias(n))
    sums = count(pred, "n_pred").join(count(gold, "n_gold"), "tree", "full").join(tp, "tree", "left").fillna(0)
    sums = sums.select("tree", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gold") - F.col("tp")).alias("fn"))
    return sums.select("*", *precision_recall(F.col("tp"), F.col("fp"), F.col("fn")))


def longest_chain(values: list) -> list[int]:
    """Positions of a longest non-decreasing subsequence; nulls are never in it. Patience piles with back links."""
    from bisect import bisect_right

    tops, places, back = [], [], {}
    for i, v in enumerate(values):
        if v is None or v != v:
            continue
        k = bisect_right(tops, v)
        back[i] = places[k - 1] if k else None
        tops[k : k + 1], places[k : k + 1] = [v], [i]
    chain, i = [], places[-1] if places else None
    while i is not None:
        chain.append(i)
        i = back[i]
    return chain[::-1]


def skeleton(candidates: list[list[int]]) -> list[int | None]:
    """For each leaf the place taken of its candidates, or None: a longest chain of strictly increasing places, one a leaf
    at most. A leaf's candidates are tried from the last to the first, so none follows another of its own."""
    from bisect import bisect_left

    tops: list[int] = []
    held: list[tuple] = []  # (leaf, place, what comes before)
    for leaf, places in enumerate(candidates):
        for place in sorted(set(places), reverse=True):
            k = bisect_left(tops, place)
            tops[k : k + 1], held[k : k + 1] = [place], [(leaf, place, held[k - 1] if k else None)]
    taken: list[int | None] = [None] * len(candidates)
    at = held[-1] if held else None
    while at:
        leaf, taken[leaf], at = at[0], at[1], at[2]
    return taken


@F.pandas_udf(t.ArrayType(t.BooleanType()))
def in_chain(values: pd.Series) -> pd.Series:
    """Of arrays of values: which are in the longest_chain()."""
    chains = ((set(longest_chain(list(v))), len(v)) for v in values)
    return pd.Series([[i in chain for i in range(n)] for chain, n in chains])


def kept_in_order(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """rows with `in_chain`: whether the row is in a longest run of values that never step back, in the order given.

    Groups are sequences of one document or parent: each becomes one row of arrays, many to a batch of the function.
    """
    rest = [c for c in rows.columns if c not in by]
    sorted_rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("order_"), *rest)))
    groups = rows.groupBy(*by).agg(sorted_rows.alias("r")).withColumn("k", in_chain(F.transform("r", lambda x: x[value])))
    return groups.select(*by, F.explode(F.arrays_zip("r", "k")).alias("x")).select(*by, *(F.col(f"x.r.{c}").alias(c) for c in rest), F.col("x.k").alias("in_chain")).select(*rows.columns, "in_chain")
