"""The driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see: below spark.checkpoint.dir, else below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt over the partitions of an exchange by their key. A table of few short columns is one or two splits of a
    file however many rows it has; work that is long for each row would run there in one or two tasks. The number is given,
    for adaptive execution joins partitions that are small, not those that are quick."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
