"""Outlines plugged into texts: spans of leaves and preambles, markers before chunks, checks and repairs, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import table
from .tree import walked

SPANS = "tree string, node string, kind string, char_start long, char_end_excl long"


def placed(nodes: DataFrame) -> DataFrame:
    """nodes (tree, id, parent, order, at) with `placed`: in pre-order, `at` isn't below that of any placed before.

    A node out of order is left aside. What is left aside lies below the bar, so it can't raise it: the running maximum
    over all nodes before is that over the placed ones.
    """
    bar = F.max("at").over(Window.partitionBy("tree").orderBy("order").rowsBetween(Window.unboundedPreceding, -1))
    return nodes.withColumn("placed", F.col("at").isNotNull() & (F.col("at") >= F.coalesce(bar, F.lit(0))))


def outlined(nodes: DataFrame, totals: DataFrame) -> DataFrame:
    """SPANS: the text from each placed node to the next; of a node with placed descendants, at any depth, it is its preamble.

    Empty spans are left out. totals: (tree, total). In pre-order a node has a placed descendant just if the next placed node is
    one, so each placed node asks its ancestors only whether the one placed before it is among them.
    """
    above = walked(nodes, F.array("id"), lambda a: F.concat(a, F.array("id"))).withColumnRenamed("state", "above")
    rows = placed(above).where("placed").join(totals, "tree")
    w = Window.partitionBy("tree").orderBy("order")
    inner = F.coalesce(F.array_contains(F.lead("above").over(w), F.col("id")), F.lit(False))
    spans = rows.withColumns({"end": F.coalesce(F.lead("at").over(w), F.col("total")), "inner": inner})
    return spans.where(F.col("end") > F.col("at")).select("tree", F.col("id").alias("node"), F.when(F.col("inner"), "preamble").otherwise("leaf").alias("kind"), F.col("at").alias("char_start"), F.col("end").alias("char_end_excl"))


def coverage(spans: DataFrame, totals: DataFrame) -> DataFrame:
    """(tree, covered, ratio, n_overlaps)."""
    before = F.max("char_end_excl").over(Window.partitionBy("tree").orderBy("char_start").rowsBetween(Window.unboundedPreceding, -1))
    sums = spans.withColumn("over", F.col("char_start") < F.coalesce(before, F.lit(0))).groupBy("tree").agg(F.sum(F.col("char_end_excl") - F.col("char_start")).alias("covered"), F.count_if("over").alias("n_overlaps"))
    return totals.join(sums, "tree", "left").select("tree", F.coalesce("covered", F.lit(0)).alias("covered"), F.round(F.try_divide(F.coalesce("covered", F.lit(0)).cast("double"), F.col("total").cast("double")), 6).alias("ratio"), F.coalesce("n_overlaps", F.lit(0)).alias("n_overlaps"))


def markers(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """(tree, node, chunk_no): each node's marker stands before the chunk that holds its first character."""
    from .intervals import as_of

    probes = spans.groupBy("tree", "node").agg(F.min("char_start").alias("at"))
    return as_of(probes, chunks.select("tree", "char_start", "chunk_no"), ["tree"], "at", "char_start", ["chunk_no"]).select("tree", "node", "chunk_no")


def findings(nodes: DataFrame) -> DataFrame:
    """(tree, id, severity, code, detail) of a node table (tree, id, parent, level, order, start, end, announced)."""
    up = nodes.select("tree", F.col("id").alias("parent"), F.col("level").alias("p_level"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    kids = nodes.where("parent IS NOT NULL").groupBy("tree", F.col("parent").alias("id")).agg(F.count("*").alias("n_kids"))
    copies = Window.partitionBy("tree", "id")
    sib = Window.partitionBy("tree", "parent").orderBy("order")
    rows = nodes.join(up.dropDuplicates(["tree", "parent"]), ["tree", "parent"], "left").join(kids, ["tree", "id"], "left")
    rows = rows.withColumn("n_ids", F.count("*").over(copies)).withColumn("before", F.max("start").over(sib.rowsBetween(Window.unboundedPreceding, -1)))
    rules: list[tuple[str, str, Column, Column]] = [
        ("error", "duplicate-id", F.col("n_ids") > 1, F.col("n_ids").cast("string")),
        ("error", "orphan", F.col("parent").isNotNull() & F.col("p_level").isNull(), F.col("parent")),
        ("error", "level", F.col("p_level").isNotNull() & (F.col("level") != F.col("p_level") + 1), F.col("level").cast("string")),
        ("error", "span-backward", F.col("end") < F.col("start"), F.col("end").cast("string")),
        ("error", "outside-parent", (F.col("start") < F.col("p_start")) | (F.col("end") > F.col("p_end")), F.col("start").cast("string")),
        ("error", "sibling-order", F.col("start") < F.col("before"), F.col("before").cast("string")),
        ("warning", "count-mismatch", F.col("announced") != F.coalesce("n_kids", F.lit(0)), F.coalesce("n_kids", F.lit(0)).cast("string")),
    ]
    hits = F.filter(F.array(*(F.when(test, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), detail.alias("detail"))) for s, c, test, detail in rules)), lambda x: x.isNotNull())
    return rows.select("tree", "id", F.explode(hits).alias("x")).select("tree", "id", "x.severity", "x.code", "x.detail")


def repaired(nodes: DataFrame, most: int = 3) -> DataFrame:
    """nodes with starts and ends clipped into the parent's span as it then is, and, among siblings, starts outside a longest
    non-decreasing chain set to null, with the end. Repeated until nothing changes, `most` times at most. `repair` names the
    last thing done; null if nothing was."""
    from .match import kept_in_order

    rows = nodes.select("tree", "id", "parent", "order", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.lit(None).cast("string").alias("repair"))
    for _ in range(most):
        up = rows.select("tree", F.col("id").alias("parent"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
        both = rows.join(up, ["tree", "parent"], "left")
        low, high = F.least("p_start", "p_end"), F.greatest("p_start", "p_end")
        clip = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), high), low))
        moved = (F.coalesce(clip("start"), F.lit(-1)) != F.coalesce("start", F.lit(-1))) | (F.coalesce(clip("end"), F.lit(-1)) != F.coalesce("end", F.lit(-1)))
        clipped = both.select("tree", "id", "parent", "order", clip("start").alias("start"), clip("end").alias("end"), F.when(moved, "clipped").otherwise(F.col("repair")).alias("repair"), moved.alias("moved"))
        chained = kept_in_order(clipped, ["tree", "parent"], "order", "start")
        out = F.col("start").isNotNull() & ~F.col("in_chain")
        kept = lambda c: F.when(~out, F.col(c)).alias(c)
        done = table(chained.select("tree", "id", "parent", "order", kept("start"), kept("end"), F.when(out, "demoted").otherwise(F.col("repair")).alias("repair"), (F.col("moved") | out).alias("moved")), "repaired")
        rows = done.drop("moved")
        if done.where("moved").isEmpty():
            break
    return rows


def eligibility(nodes: DataFrame, split: str, scope: Column, covered: Column) -> DataFrame:
    """nodes with `reason`: why a node isn't counted, or 'counted'; the first rule that holds names it."""
    reason = F.when(F.col("line").isNull(), "no_key").when(F.col("split").isNull(), "split_unknown").when(F.col("split") != split, "out_of_split").when(~scope, "out_of_scoring_scope").when(~covered, "out_of_coverage")
    return nodes.withColumn("reason", F.coalesce(reason, F.lit("counted")))


def markdown(nodes: DataFrame) -> DataFrame:
    """(tree, md): one line per node in pre-order, indented by level. Each tree is one row: documents, not corpora."""
    line = F.concat(F.repeat(F.lit("  "), (F.col("level") - 1).cast("int")), F.lit("- ["), "id", F.lit("] "), F.coalesce("heading", F.lit("")))
    return nodes.groupBy("tree").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", line.alias("line")))), lambda x: x["line"]), "\n").alias("md"))


def parse_markdown(texts: DataFrame) -> DataFrame:
    """(tree, order, level, id, heading) of markdown()."""
    form = r"^((?:  )*)- \[([^\]]*)\] (.*)$"
    rows = texts.select("tree", F.posexplode(F.split("md", "\n")).alias("i", "line"))
    part = lambda k: F.regexp_extract("line", form, k)
    return rows.select("tree", (F.col("i") + 1).cast("bigint").alias("order"), (F.length(part(1)) / 2 + 1).cast("bigint").alias("level"), part(2).alias("id"), part(3).alias("heading"))
