"""Samples that any engine can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def stratified(rows: DataFrame, by: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each group, by a seeded digest of the key; a limit within each partition comes before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def newest(rows: DataFrame, seq: str, n: int) -> DataFrame:
    """A bounded memory: the n rows with the highest number."""
    return rows.orderBy(F.desc(seq)).limit(n)


def unite(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Both pools; of rows with one key that of the second stays."""
    both = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)))
    names = [c for c in first.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*names), "_p").alias("v")).select(key, *(f"v.{c}" for c in names))
