"""Reading tables, and cutting lineage with tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`; bytes.split() splits at exactly these.
WORD_GAP = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a session on one machine gets a temporary folder; a cluster
    is refused, since its executors share no local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        folder = tempfile.mkdtemp(prefix="strophe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and rereads it: later jobs survive the loss of executors and don't recompute."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_ = path
    return found


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that table() made, on which nothing that is still to run depends."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.stored_)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def sized(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df, a stored table of a few numbers a row, marked for broadcast if it has at most `most` rows (some 50 MB); a larger
    one is left to be shuffled. The rows are counted from the files' footers."""
    return F.broadcast(df) if df.count() <= most else df


def in_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of batches whose first `keys` columns (numbers, without nulls) are equal, a table per group; rows of a group
    must follow one another. Only one group is held at a time."""
    parts: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], axis=1)
        starts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        bounds = [0, *starts.tolist(), b.num_rows]
        for at, to in zip(bounds, bounds[1:]):
            if parts and not np.array_equal(k[at], last):
                yield pa.Table.from_batches(parts)
                parts = []
            parts.append(b.slice(at, to - at))
            last = k[at]
    if parts:
        yield pa.Table.from_batches(parts)


def words(text: str | None) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text whose A-Z are lower-cased; null has none."""
    return text.encode().lower().split() if text else []


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def held_out(column: str, modulus: int, rest: int):
    """crc32 of the id's decimal text has that remainder; a null id hasn't."""
    return F.coalesce(F.crc32(F.encode(F.col(column).cast("string"), "UTF-8")) % modulus == rest, F.lit(False))
