"""Sentences with offsets, and chunks of consecutive sentences under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules for Latin script; others are passed as arguments.
TERMINATORS, CLOSERS = ".!?", "\"')\\]"
CUT = "\x01"
SENTENCES, CHARACTERS = 6, 180  # the default budget of a chunk
BLOCK = 256  # values whose results are gathered before they are joined to the rest


def sentence_pieces(text: Column, terminators: str = TERMINATORS, closers: str = CLOSERS) -> Column:
    """A text cut after each run of terminators with the closers and white space that follow; nothing is lost."""
    marked = F.regexp_replace(text, f"([{terminators}]+[{closers}]*[ \\t\\r\\n]*)", f"$1{CUT}")
    return F.filter(F.split(marked, CUT), lambda s: s != "")


def folded(values: Column, zero: Column, step, out: str) -> Column:
    """What step emits for each value, by a fold: step(state, value) is a struct of the new state and of `out`, the value emitted.

    An array grows by copying, so emitted values are gathered in blocks of BLOCK and blocks are joined: copies per value are
    BLOCK / 2 and, of long arrays, a share of their length / BLOCK.
    """
    empty = F.array().cast(f"array<{out}>")

    def one(a: Column, x: Column) -> Column:
        made = step(a["state"], x)
        return F.struct(made["state"].alias("state"), F.concat(a["out"], F.array(made["out"])).alias("out"))

    def block(a: Column, xs: Column) -> Column:
        inner = F.aggregate(xs, F.struct(a["state"].alias("state"), empty.alias("out")), one)
        return F.struct(inner["state"].alias("state"), F.concat(a["out"], inner["out"]).alias("out"))

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / BLOCK).cast("int") - 1, F.lit(0))), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        start = F.struct(zero.alias("state"), empty.alias("out"))
        return F.when(F.size(v) <= BLOCK, F.aggregate(v, start, one, lambda a: a["out"])).otherwise(F.aggregate(blocks, start, block, lambda a: a["out"]))

    return F.element_at(F.transform(F.array(values), whole), 1)  # so that the values are computed once, not again for each block


def starts_of(lengths: Column) -> Column:
    """Running offsets of an array of lengths."""
    return folded(lengths, F.lit(0).cast("bigint"), lambda at, n: F.struct((at + n).alias("state"), at.alias("out")), "bigint")


def sentences(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """(id, sent_no from 0, char_start, char_end_excl, sentence): contiguous, in code points, covering the text."""
    pieces = documents.select(F.col(id_col), sentence_pieces(F.col(text_col), **rules).alias("p"))
    placed = pieces.withColumn("s", starts_of(F.transform("p", lambda x: F.length(x).cast("bigint"))))
    rows = placed.select(id_col, F.posexplode(F.arrays_zip("p", "s")).alias("sent_no", "x"))
    return rows.select(id_col, F.col("sent_no").cast("bigint").alias("sent_no"), F.col("x.s").alias("char_start"), (F.col("x.s") + F.length("x.p")).alias("char_end_excl"), F.col("x.p").alias("sentence"))


def windows_of(lengths: Column, cap: Column, budget: int) -> Column:
    """Number of the greedy window of each atom: a window closes when one more sentence would pass the cap, or one more
    atom the character budget; an atom that alone passes it stands alone."""
    zero = F.struct(F.lit(-1).alias("w"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("c"))

    def step(a: Column, length: Column) -> Column:
        fits = (a["w"] >= 0) & (a["n"] + 1 <= cap) & (a["c"] + length <= budget)
        w = F.when(fits, a["w"]).otherwise(a["w"] + 1)
        return F.struct(F.struct(w.alias("w"), F.when(fits, a["n"] + 1).otherwise(1).alias("n"), F.when(fits, a["c"] + length).otherwise(length).alias("c")).alias("state"), w.alias("out"))

    return folded(lengths, zero, step, "int")


def window_count(lengths: Column, cap: Column, budget: int) -> Column:
    """How many greedy windows there are, by a fold that keeps no array."""
    zero = F.struct(F.lit(0).alias("w"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("c"))

    def step(a: Column, length: Column) -> Column:
        fits = (a["w"] > 0) & (a["n"] + 1 <= cap) & (a["c"] + length <= budget)
        return F.struct(F.when(fits, a["w"]).otherwise(a["w"] + 1).alias("w"), F.when(fits, a["n"] + 1).otherwise(1).alias("n"), F.when(fits, a["c"] + length).otherwise(length).alias("c"))

    return F.aggregate(lengths, zero, step, lambda a: a["w"])


def chunked(documents: DataFrame, cap: int = SENTENCES, budget: int = CHARACTERS, balanced: bool = False, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """(id, chunk_no, first_sentence, n_sentences, char_start, char_end_excl, n_chars) of greedy or balanced chunks.

    Balanced windows use the smallest cap, from the mean number of sentences up, that gives no more windows than the
    greedy cut has: 20 sentences at cap 6 become 5 + 5 + 5 + 5. Each document is one row throughout: no shuffle.
    """
    lengths = documents.select(F.col(id_col), F.transform(sentence_pieces(F.col(text_col), **rules), lambda x: F.length(x).cast("bigint")).alias("l"))
    if balanced:
        counted = lengths.withColumn("k", window_count(F.col("l"), F.lit(cap), budget))
        low = F.greatest(F.lit(1), F.ceil(F.size("l") / F.greatest("k", F.lit(1))).cast("int"))
        caps = F.when((F.col("k") >= 2) & (low < cap), F.filter(F.sequence(low, F.lit(cap - 1)), lambda c: window_count(F.col("l"), c, budget) == F.col("k")))
        lengths = counted.withColumn("cap", F.coalesce(F.try_element_at(caps, F.lit(1)), F.lit(cap))).drop("k")
    else:
        lengths = lengths.withColumn("cap", F.lit(cap))
    rows = lengths.withColumn("w", windows_of(F.col("l"), F.col("cap"), budget)).withColumn("s", starts_of(F.col("l")))
    atoms = rows.select(id_col, F.posexplode(F.arrays_zip("w", "s", "l")).alias("sent_no", "x"))
    return atoms.groupBy(id_col, F.col("x.w").cast("bigint").alias("chunk_no")).agg(
        F.min("sent_no").cast("bigint").alias("first_sentence"), F.count("*").alias("n_sentences"), F.min("x.s").alias("char_start"),
        F.max(F.col("x.s") + F.col("x.l")).alias("char_end_excl"), F.sum("x.l").alias("n_chars"),
    )


def chunk_stats(chunks: DataFrame, cap: int = SENTENCES, budget: int = CHARACTERS, id_col: str = "doc_id") -> DataFrame:
    """Per document: n_sentences, n_chunks, max_chars, median_chars, over_budget (single sentences longer than it)."""
    return chunks.groupBy(id_col).agg(
        F.sum("n_sentences").alias("n_sentences"), F.count("*").alias("n_chunks"), F.max("n_chars").alias("max_chars"),
        F.median("n_chars").alias("median_chars"), F.count_if((F.col("n_chars") > budget) | (F.col("n_sentences") > cap)).alias("over_budget"),
    )
