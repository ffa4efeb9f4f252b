"""Documents and corrections as they arrive: scored against fixed postings, learned in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.knockouts import Person, Rules, outcome
from ..operators.scoring import Keyword, Requirement


def score_arrivals(stream: DataFrame, rules: Rules, requirements: list[Requirement], pool_scores: DataFrame, policy: str = "review", who: Person | None = None) -> DataFrame:
    """doc_id, status, reasons, score, better: of the pool's scores those that are higher. A document keeps no state.

    pool_scores: (score, higher), a row for each distinct score with the number of rows above it: at most as many
    rows as a four-decimal score has values, so it is sent to every task.
    """
    own = stream.select("doc_id", outcome(who or Person.of_columns(), rules, policy).alias("o"), F.round(Keyword().score("text", requirements), 4).alias("score"))
    own = own.select("doc_id", "o.status", "o.reasons", "score")
    steps = pool_scores.agg(F.array_sort(F.collect_list(F.struct("score", "n"))).alias("steps"))
    out = own.crossJoin(F.broadcast(steps))
    better = F.aggregate(F.filter("steps", lambda s: s["score"] > F.col("score")), F.lit(0).cast("long"), lambda a, s: a + s["n"])
    return out.select("doc_id", "status", "reasons", "score", better.alias("better"))


def pool_steps(scored: DataFrame, score: str = "score") -> DataFrame:
    """(score, n): how many of the pool have each score."""
    return scored.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"))


def learn_from(stream: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that hands each micro-batch of corrections to update(batch, number) once; update must bear a repeat of a number."""
    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
