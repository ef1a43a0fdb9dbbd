"""Reading the tables that the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over as many tasks as a shuffle has: a small file, or one with few row groups, is read by a few, which would also do
    all the work that follows. Nor are these tasks made fewer, so what one holds is its share. For rows whose processing costs far
    more than moving them, or that are grouped by the key anyway."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
