"""Mixing sources to target weights: temperature, bisected; weights realised as permuted blocks under a token budget.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Documents of a source fall into so many blocks by a hash of their id; whole blocks are taken, and only the block in
#: which the quota ends is ranked.
SOURCE_BLOCKS = 256
#: Blocks of the mixture, in each of which the sources have their weights.
MIX_BLOCKS = 64
STEPS, POINTS = 5, 32  # the exponent is found to 2 ** -25


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exponent(sources: DataFrame, entropy: float, repeats: float, budget: int | None) -> float:
    """The exponent a in 0..1 of weights share ** a.

    It is the largest whose weights have at least `entropy` of the entropy of equal weights (1 if the shares have),
    or, where some source would then be repeated more than `repeats` times, the smallest that keeps this limit (1 if
    none does). Repeats are counted by the budget, or without one by that which takes every document once. Each step
    looks at POINTS exponents at once; one row of a few numbers reaches the driver.
    """
    some = sources.where("tokens > 0")
    total, n = some.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).head()
    if not n:
        return 1.0
    shares = some.select("tokens", (F.col("tokens") / F.lit(total)).alias("p"))
    raw = F.pow("p", F.col("a"))
    equal = F.lit(entropy) * F.log(F.lit(float(n)))

    def measures(low: float, wide: float) -> list:
        grid = F.explode(F.expr(f"transform(sequence(0, {POINTS}), i -> {low!r}D + i * {wide!r}D / {POINTS})"))
        z = shares.withColumn("a", grid).groupBy("a").agg(
            F.sum(raw).alias("z"), F.sum(raw * F.log("p")).alias("zl"),
            F.max(raw / F.col("tokens")).alias("most"), F.min(raw / F.col("tokens")).alias("least"),
        )
        rep = F.col("most") / F.col("least") if budget is None else F.lit(float(budget)) * F.col("most") / F.col("z")
        enough = F.log("z") - F.col("a") * F.col("zl") / F.col("z") >= equal - 1e-12
        return z.select("a", enough.alias("enough"), (rep <= repeats).alias("within")).orderBy("a").collect()

    def search(wanted) -> float:
        """Between points that differ in `wanted` (true, then false), the last that has it; the first or last if all are alike."""
        low, wide = 0.0, 1.0
        for _ in range(STEPS):
            rows = measures(low, wide)
            have = [k for k, r in enumerate(rows) if wanted(r)]
            if not rows or len(have) == len(rows):
                return low + wide
            if not have:
                return low
            low, wide = low + max(have) * wide / POINTS, wide / POINTS
        return low

    by_entropy = search(lambda r: r.enough)
    by_limit = search(lambda r: not r.within)
    unit = 2.0 ** -(STEPS * (POINTS.bit_length() - 1))
    by_limit = 0.0 if by_limit == 0.0 and measures(0.0, 1.0)[0].within else min(1.0, by_limit + unit)
    return max(by_entropy, by_limit)


def mix(documents: DataFrame, entropy: float = 0.95, repeats: float = 2.0, budget: int | None = None, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The mixture: a row per copy of a document that is taken.

    Columns: doc_id, source, tokens (words of the whole text), epoch (from 0), block (of the mixture, from 0),
    order_key (the permutation within a block), weight (of the source), and those named in `keep` (these come first,
    and names that clash with the ones above stay the documents' own). Weights are share ** exponent, normalised; a
    source's quota is weight * budget tokens. Without a budget the quotas are the least by which every document is
    taken once. A quota of r times a source's tokens takes all its documents floor(r) times, and in the last epoch
    whole blocks of its documents, permuted by hash, then documents of the next block, as long as they fit.

    A null source is a source of its own, a null text has no tokens; documents without tokens go with their block, and
    those of a source without any tokens are taken once. Rows that repeat are documents of their own. An empty table gives no
    rows.
    """
    keep, own = keep or [], "_mix_"
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(str(seed))))
    named = documents.select(
        *(F.col(c).alias(f"{own}keep_{c}") for c in keep), F.col(id_col).alias(own + "id"), F.col(source_col).alias(own + "source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("\0null")).alias(own + "s"), word_count(F.col(text_col).cast("string")).alias(own + "tokens"), digest.alias(own + "digest"),
    )
    docs = named.withColumn(own + "b", (F.conv(F.substring(own + "digest", 1, 8), 16, 10).cast("long") % SOURCE_BLOCKS).cast("int"))
    blocks = table(docs.groupBy(F.col(own + "s").alias("s"), F.col(own + "b").alias("b")).agg(F.sum(own + "tokens").alias("tokens")), "blocks")
    sources = table(blocks.groupBy("s").agg(F.sum("tokens").alias("tokens")), "sources")
    a = exponent(sources, entropy, repeats, budget)
    total = sources.agg(F.greatest(F.sum("tokens"), F.lit(1))).head()[0] or 1
    raw = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(total), F.lit(a)))
    rated = sources.withColumn("raw", raw)
    z, least = rated.agg(F.coalesce(F.sum("raw"), F.lit(1.0)), F.coalesce(F.min(F.col("raw") / F.col("tokens")), F.lit(1.0))).head()
    r = F.col("raw") / F.col("tokens") / F.lit(least) if budget is None else F.lit(float(budget)) * F.col("raw") / F.lit(z) / F.col("tokens")
    quotas = rated.select("s", (F.coalesce(F.col("raw"), F.lit(0.0)) / F.lit(z)).alias("weight"), F.coalesce(r, F.lit(1.0)).alias("r"), F.col("tokens").alias("source_tokens"))
    quotas = quotas.withColumn("full", F.floor("r").cast("int")).withColumn("rest", F.floor((F.col("r") - F.floor("r")) * F.col("source_tokens")).cast("long"))
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # SOURCE_BLOCKS rows a source
    cuts = blocks.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0))).join(quotas, "s")
    whole = F.when(F.col("rest") <= 0, 0).when(F.col("before") + F.col("tokens") <= F.col("rest"), 2).when(F.col("before") < F.col("rest"), 1).otherwise(0)
    cuts = table(cuts.select("s", "b", "weight", "r", "full", (F.col("rest") - F.col("before")).alias("room"), whole.alias("part")), "cuts")
    joined = docs.join(cuts, (F.col(own + "s") == F.col("s")) & (F.col(own + "b") == F.col("b")))
    fits = Window.partitionBy("s", "b").orderBy(F.substring(own + "digest", 9, 24), own + "id", own + "tokens").rowsBetween(Window.unboundedPreceding, 0)
    cut = joined.where("part = 1").withColumn("last", F.sum(own + "tokens").over(fits) <= F.col("room"))
    rest = joined.where("part <> 1").withColumn("last", F.col("part") == 2)
    copies = cut.unionByName(rest).withColumn("epochs", F.col("full") + F.col("last").cast("int")).where("epochs > 0")
    placed = copies.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    block = F.least(F.lit(MIX_BLOCKS - 1), F.floor((F.col("epoch") + (F.col("b") + 0.5) / SOURCE_BLOCKS) / F.greatest("r", F.lit(1e-9)) * MIX_BLOCKS)).cast("int")
    kept = [F.col(f"{own}keep_{c}").alias(c) for c in keep]
    made = {
        "doc_id": F.col(own + "id"), "source": F.col(own + "source"), "tokens": F.col(own + "tokens"), "epoch": F.col("epoch"), "block": block,
        "order_key": F.md5(F.concat_ws(":", own + "digest", F.col("epoch").cast("string"))), "weight": F.round("weight", 6),
    }
    return placed.select(*kept, *(c.alias(n) for n, c in made.items() if n not in keep))
