"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder of our own only where it is unset on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='ashlar-')}"
        spark.sparkContext.setCheckpointDir(named)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: lineage ends there."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/ashlar/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what :func:`stored` wrote; nothing may read it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Hands memory that is free in this worker back to the system: workers live on, beside others, when their task is over."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # there is none but with the GNU library
    if trim is not None:
        trim(0)


#: Keys with more than a ``HOT_KEYS``-th of all rows are joined apart: there are fewer than ``HOT_KEYS`` of them.
HOT_KEYS = 4096
HOT_LEAST = 256


def join_hot(big: DataFrame, small: DataFrame, key: str, n: str, total: int | None = None) -> DataFrame:
    """``big`` joined with ``small``, which has each key once and in column ``n`` its number of rows in ``big``.

    Hot keys' rows of ``small``, fewer than ``HOT_KEYS`` of them, are broadcast, so that their rows of ``big`` stay where
    they are; all other keys are shuffled.  ``total`` is the sum of ``n``, or a number that is not below it, if known.
    """
    if total is None:
        total = small.agg(F.sum(n).alias("n")).first()["n"] or 0
    rows = small.where(F.col(n) > max(HOT_LEAST, total // HOT_KEYS)).collect()
    if not rows:
        return big.join(small, key).drop(n)
    hot = F.broadcast(small.sparkSession.createDataFrame(rows, small.schema))
    keys = F.broadcast(hot.select(key))
    rest = big.join(keys, key, "left_anti").join(small, key)
    return rest.unionByName(big.join(hot, key)).drop(n)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: the CRC-32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, what: str) -> DataFrame:
    """(text, y) of at most ``rows`` labelled documents that are not held out, in the order of a hash of their ids.

    The ids are at most ``rows`` in number, so that they are broadcast; documents are read once.  Of rows that repeat an
    id the least text is taken, the same in every run.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    some = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return stored(some.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")), what)
