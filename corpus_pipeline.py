"""A training corpus from raw documents: five stages, each a DataFrame written as Parquet and reread by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm.common import load, sized, table
from strophe.llm.language_id import identify, learn
from strophe.llm.mixing import mix
from strophe.llm.near_dedup import grouped
from strophe.llm.packing import pack
from strophe.llm.quality import rated

LEAST_SHARE = 0.5  # of the main language in a text that stays


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, with their columns.

    Rows are told apart by id and text, null ones too: equal rows stay or go together. Null, empty and very long texts are
    judged by their shape like any other; an empty table stays empty.
    """
    hashed = F.xxhash64("text")
    bad = rated(docs, load(spark, sf_dir, "labels"), text_hash=True).where("NOT keep").select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_")).distinct()
    bad = sized(table(bad, "rejected"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["id_"]) & (hashed == bad["hash_"]), "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mostly in one language that was learnt, with their columns; und and mixtures without a main language go.

    Null texts and texts without letters are und; equal rows have one fate; whole texts are read; an empty table stays empty.
    """
    names = [f"in_{i}_" for i in range(len(docs.columns))]
    model = learn(docs)
    found = identify(docs, model, extra=[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    found = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return found.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8), that with the smallest id.

    Ties between texts of one id go to the smaller hash, and of equal rows one stays. Documents without words or without an
    id have no copies and stay, all of them. Texts of any length are read whole; an empty table stays empty.
    """
    found = table(grouped(docs, width=5, percent=80), "grouped").where("group IS NOT NULL").select("group", "doc_id", "text_hash")
    first = found.groupBy("group").agg(F.count("*").alias("rows"), F.min(F.struct("doc_id", "text_hash")).alias("first")).where("rows > 1")
    members = table(found.join(first.select("group", "first"), "group").groupBy("doc_id", "text_hash").agg(F.first(F.struct("doc_id", "text_hash") == F.col("first")).alias("stays"), F.count("*").alias("rows")).where("NOT stays OR rows > 1"), "members")
    row = lambda df, f: table(df.where(f).select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_")), "rows")
    gone, again = row(members, "true"), row(members, "stays")
    same = lambda df: (F.col("doc_id") == df["id_"]) & (F.xxhash64("text") == df["hash_"])
    alone = docs.join(sized(gone), same(gone), "left_anti")
    if again.isEmpty():
        return alone
    return alone.unionByName(docs.join(sized(again), same(again), "left_semi").dropDuplicates(["doc_id", "text"]))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, and again as often as its source's weight asks for: a row per copy.

    Null sources are a source of their own; null and empty texts and null ids are mixed like others; repeated rows are copies
    of their own; ties in the order go by id; an empty table stays empty.
    """
    return mix(docs, keep=docs.columns).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens, as pack() gives them.

    A null or empty text is one end token; null ids stay null; repeated rows are packed once each; a long text is cut into
    pieces; other columns are left out; an empty table gives no rows.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024)


STAGES = [("quality", quality), ("language", language), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Classifiers and sketches aren't expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
