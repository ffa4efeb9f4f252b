"""Shared folder, tables cut from their lineage, and sizes taken from the session."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where none is set and there is one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="winnowry-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str = "stash") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and computes it once."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freed(work: Callable) -> Callable:
    """work on batches, after which the Python worker, which is used again, gives back the memory that it no longer needs."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            gc.collect(0)
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return run


def width(spark: SparkSession) -> int:
    """Partitions of an exchange: what the session is set to, which has to grow with the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of keys that a broadcast may hold; a longer list is joined by a shuffle.
BROADCAST_ROWS = 500_000


def without(docs: DataFrame, gone: DataFrame, condition) -> DataFrame:
    """Rows of docs that match no row of gone. The list is counted, and sent to the texts while it is short."""
    gone = stash(gone, "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, condition(docs, gone), "left_anti")
