"""Rooted ordered trees as tables (tree, id, parent, ord): numbering, paths, spans and checks, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import table


def walked(nodes: DataFrame, seed: Column, step, most: int = 64) -> DataFrame:
    """nodes with a column `state`, carried from the roots down: `seed` at a root, step(parent's state) below it.

    A loop over levels; each level is one equi-join of the level above with its children, written as a table, so the
    number of jobs is the depth, whatever the size, and neither the nodes nor a level are computed twice. Nodes that no
    root reaches are left out; nodes below level `most` are an error.
    """
    nodes = table(nodes, "nodes")
    rest = nodes.where("parent IS NOT NULL").alias("n")
    level = table(nodes.where("parent IS NULL").withColumn("state", seed), "level")
    found, depth = level, 1
    while True:
        above = level.select(F.col("tree").alias("t_"), F.col("id").alias("p_"), F.col("state").alias("above_"))
        level = rest.join(above, (F.col("n.tree") == F.col("t_")) & (F.col("n.parent") == F.col("p_"))).select("n.*", step(F.col("above_")).alias("state"))
        level = table(level, "level")
        if level.isEmpty():
            break
        if depth == most:
            raise ValueError(f"a root reaches nodes below level {most}")
        found, depth = found.unionByName(level), depth + 1
    return found


def numbered(nodes: DataFrame) -> DataFrame:
    """(tree, id, parent, level, sibling_index, path, order): pre-order, siblings by ord then id, all from 1.

    path holds the sibling numbers from the root, zero-padded so that its order is the tree's order.
    """
    sib = Window.partitionBy("tree", "parent").orderBy("ord", "id")
    base = nodes.withColumn("sibling_index", F.row_number().over(sib).cast("bigint"))
    token = F.lpad(F.col("sibling_index").cast("string"), 8, "0")
    placed = walked(base, token, lambda above: F.concat(above, F.lit("."), token))
    pre = Window.partitionBy("tree").orderBy("state")
    return placed.select("tree", "id", "parent", F.size(F.split("state", "\\.")).cast("bigint").alias("level"), "sibling_index", F.col("state").alias("path"), F.row_number().over(pre).cast("bigint").alias("order"))


def subtree_sizes(tree: DataFrame) -> DataFrame:
    """numbered() rows with `size`: descendants and the node itself. Each node is counted at each of its ancestors."""
    up = tree.select("tree", F.explode(F.expr("transform(sequence(1, size(split(path, '[.]'))), k -> array_join(slice(split(path, '[.]'), 1, k), '.'))")).alias("path"))
    return tree.join(up.groupBy("tree", "path").agg(F.count("*").alias("size")), ["tree", "path"])


def next_node(tree: DataFrame) -> DataFrame:
    """subtree_sizes() rows with `next_order` and `next_id`: the first node after the subtree; null at the end."""
    after = tree.select("tree", F.col("order").alias("next_order"), F.col("id").alias("next_id"))
    return tree.withColumn("next_order", F.col("order") + F.col("size")).join(after, ["tree", "next_order"], "left").withColumn("next_order", F.when(F.col("next_id").isNotNull(), F.col("next_order")))


def nearest_flagged(nodes: DataFrame, flag: Column) -> DataFrame:
    """(tree, id, flagged_above): the nearest proper ancestor with the flag; null without one."""
    start = F.struct(F.lit(None).cast("string").alias("seen"), F.when(flag, F.col("id")).alias("own"))
    down = lambda a: F.struct(F.coalesce(a["own"], a["seen"]).alias("seen"), F.when(flag, F.col("id")).alias("own"))
    return walked(nodes, start, down).select("tree", "id", F.col("state.seen").alias("flagged_above"))


def reachable(nodes: DataFrame, covered: Column) -> DataFrame:
    """(tree, id, covered, all_above_covered): whether the node and all its ancestors are covered."""
    return walked(nodes, F.coalesce(covered, F.lit(False)), lambda a: a & F.coalesce(covered, F.lit(False))).select("tree", "id", F.coalesce(covered, F.lit(False)).alias("covered"), F.col("state").alias("all_above_covered"))


def withheld(nodes: DataFrame, reason: Column) -> DataFrame:
    """(tree, id, reason): nodes withheld for a reason of their own or the nearest ancestor's."""
    return walked(nodes, reason, lambda a: F.coalesce(reason, a)).select("tree", "id", F.col("state").alias("reason")).where("reason IS NOT NULL")


def content_keys(nodes: DataFrame, content: list[str]) -> DataFrame:
    """(tree, id, key): a hash of the parent's key, the content and its number among equal siblings; a renumbering of
    other siblings leaves it alone."""
    tie = Window.partitionBy("tree", "parent", *content).orderBy("ord", "id")
    base = nodes.withColumn("tie_", F.row_number().over(tie))
    own = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content), F.col("tie_").cast("string"))
    return walked(base, F.sha2(F.concat(F.lit("|"), own), 256), lambda a: F.sha2(F.concat(a, F.lit("|"), own), 256)).select("tree", "id", F.col("state").alias("key"))


def level_counts(tree: DataFrame) -> DataFrame:
    return tree.groupBy("tree", "level").agg(F.count("*").alias("n"))


def parents_of_levels(rows: DataFrame, by: list[str], order: str, level: str) -> DataFrame:
    """(by, order, level, parent_at): the nearest row before with a smaller level, null at a root.

    One fold over the rows of a document holds the open path as a stack: rows not shallower than the next one leave it.
    """
    item = F.struct(F.col(order).alias("at"), F.col(level).alias("level"))
    kind = rows.select(item.alias("x")).schema["x"].dataType.simpleString()
    at = rows.schema[order].dataType.simpleString()
    zero = F.struct(F.array().cast(f"array<{kind}>").alias("open"), F.array().cast(f"array<struct<at:{at},level:{rows.schema[level].dataType.simpleString()},parent_at:{at}>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        above = F.filter(a["open"], lambda o: o["level"] < x["level"])
        made = F.struct(x["at"].alias("at"), x["level"].alias("level"), F.try_element_at(above, F.lit(-1))["at"].alias("parent_at"))
        return F.struct(F.concat(above, F.array(x)).alias("open"), F.concat(a["out"], F.array(made)).alias("out"))

    folded = rows.groupBy(*by).agg(F.aggregate(F.array_sort(F.collect_list(item)), zero, step, lambda a: a["out"]).alias("out"))
    return folded.select(*by, F.explode("out").alias("x")).select(*by, F.col("x.at").alias(order), F.col("x.level").alias(level), "x.parent_at")
