"""Connected components of an edge table, by repeated contraction towards randomly ranked neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stash


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(a, b), both long: nodes share a root if a path joins them.

    A round joins every node to the neighbour (or itself) of least random rank and keeps what still differs.
    A constant share of the nodes goes each round, so rounds grow as the logarithm of the largest component. All
    is done by key, with map-side minimums; only the number of edges left reaches the driver.
    """
    left = stash(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = None
    for turn in range(200):
        if left.isEmpty():
            break
        both = left.select(F.col("a").alias("node"), F.col("b").alias("near")).unionAll(left.select("b", "a"))
        both = both.unionAll(both.select("node", F.col("node").alias("near")))
        step = stash(both.groupBy("node").agg(F.min_by("near", F.xxhash64("near", F.lit(turn))).alias("to")), "step")
        to_a, to_b = step.toDF("a", "to_a"), step.toDF("b", "to_b")
        left = stash(left.join(to_a, "a").join(to_b, "b").where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        if label is None:
            label = step.select("node", F.col("to").alias("root"))
        else:
            moved = step.toDF("root", "to")
            label = stash(label.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "label")
    else:
        raise RuntimeError("components did not settle")
    return label if label is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
