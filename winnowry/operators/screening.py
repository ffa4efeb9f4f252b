"""A pool of candidates against a posting: rules, scores, ranks."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .knockouts import Person, Rules, outcome
from .scoring import Keyword, Requirement, Scorer

#: Scores count as equal within this.
TOLERANCE = 1e-12


def competition_rank(score: Column, eligible: Column, *by: str) -> Column:
    """Rank from the highest score among the eligible, equal scores alike; the others have none."""
    return F.when(eligible, F.rank().over(Window.partitionBy(*by, eligible).orderBy(F.desc(score))))


def step(score: Column) -> Column:
    """A score of four decimals as a whole number."""
    return F.round(score * 10_000).cast("long")


def standings(pool: DataFrame, *others: DataFrame) -> DataFrame:
    """(step, n, better): for each score the pool scores that equal it and those above it; scores of others are listed too.

    Tables of a column score. Shares of four decimals have 10,001 steps at most, however large the pool: map-side counts
    are what is shuffled, and the running sum sees one row a step.
    """
    rows = pool.select(step(F.col("score")).alias("step"), F.lit(1).alias("n"))
    for o in others:
        rows = rows.unionAll(o.select(step(F.col("score")), F.lit(0)))
    above = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy("step").agg(F.sum("n").alias("n")).withColumn("better", F.coalesce(F.sum("n").over(above), F.lit(0)))


def screen(pool: DataFrame, rules: Rules, requirements: list[Requirement], scorers: list[Scorer] | None = None, policy: str = "review", who: Person | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, status, reasons, missing, and score_ and rank_ of each scorer. Rejected rows stay, without a rank.

    The scored rows, without their texts, are kept on the executors' disks for the two passes that ranks take: one that
    counts scores, one that looks up how many are better. What an executor loses is computed again.
    """
    scorers = scorers or [Keyword()]
    own = pool.select(F.col(doc_id).alias("doc_id"), outcome(who or Person.of_columns(), rules, policy).alias("o"), *(F.round(s.score(text, requirements), 4).alias(f"score_{s.name}") for s in scorers))
    own = own.select("doc_id", "o.*", *(f"score_{s.name}" for s in scorers)).persist(StorageLevel.DISK_ONLY)
    return with_ranks(own, [s.name for s in scorers], F.col("status") != "REJECT")


def with_ranks(scored: DataFrame, names: list[str], eligible: Column) -> DataFrame:
    """scored with rank_ of each score_: among the eligible rows one more than those that score higher; the others have none."""
    out = scored
    for n in names:
        steps = standings(scored.where(eligible).select(F.col(f"score_{n}").alias("score"))).select(F.col("step").alias("_step"), (F.col("better") + 1).alias("_rank"))
        out = out.join(F.broadcast(steps), step(F.col(f"score_{n}")) == F.col("_step"), "left").withColumn(f"rank_{n}", F.when(eligible, F.col("_rank"))).drop("_step", "_rank")
    return out


def screen_postings(pool: DataFrame, postings: dict[str, tuple[Rules, list[Requirement]]], scorers: list[Scorer] | None = None, policy: str = "review", **columns) -> DataFrame:
    """screen() for each of several postings, by posting_id; the pool is read once a posting."""
    out = None
    for name, (rules, requirements) in postings.items():
        one = screen(pool, rules, requirements, scorers, policy, **columns).select(F.lit(name).alias("posting_id"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def in_order(screened: DataFrame, primary: str = "keyword") -> DataFrame:
    """By the rank of the primary scorer, rejected rows last, then by id."""
    return screened.orderBy(F.asc_nulls_last(f"rank_{primary}"), F.asc("doc_id"))


def rank_of(scores: DataFrame, score: str) -> DataFrame:
    """Each row's rank among the others: one more than those that score higher, by scores of four decimals."""
    steps = standings(scores.select(F.col(score).alias("score"))).select(F.col("step").alias("_step"), (F.col("better") + 1).alias("rank_in_pool"))
    return scores.join(F.broadcast(steps), step(F.col(score)) == F.col("_step"), "left").drop("_step")


def positions(scored: DataFrame, score: str) -> DataFrame:
    """scored with what each row meets in the others of the pool: rank, of, best_other, median_other and top_percent.

    median_other is the upper median: the score at place n div 2 of the n others in ascending order, never a mean.
    top_percent is the rank as a share of all in whole per cents, 1 at least. All come from the counts of the scores.
    """
    steps = standings(scored.select(F.col(score).alias("score")))
    total = F.sum("n").over(Window.partitionBy())  # over one row a step
    line = steps.select("step", "n", "better", total.alias("all")).withColumn("upto", F.col("all") - F.col("better"))  # rows at or below a step
    # Of n others the place n div 2: one place farther on for a row that itself stands at or before it.
    place = F.floor((F.col("all") - 1) / 2)
    line = line.withColumns({"low": F.col("upto") - F.col("n"), "place": place})
    middle = line.agg(
        F.max("all").alias("all"), F.max(F.when((F.col("low") <= F.col("place")) & (F.col("place") < F.col("upto")), F.col("step"))).alias("mid"),
        F.max(F.when((F.col("low") <= F.col("place") + 1) & (F.col("place") + 1 < F.col("upto")), F.col("step"))).alias("next"),
        F.max("step").alias("best"), F.max_by("n", "step").alias("n_best"), F.max(F.when(F.col("better") > 0, F.col("step"))).alias("second"),
    )
    own = scored.join(F.broadcast(steps.select(F.col("step").alias("_step"), "better")), step(F.col(score)) == F.col("_step")).crossJoin(F.broadcast(middle))
    rank, of = F.col("better") + 1, F.col("all")
    back = lambda c: F.when(of > 1, c / 10_000)
    best = F.when((F.col("_step") == F.col("best")) & (F.col("n_best") == 1), F.col("second")).otherwise(F.col("best"))
    return own.select(
        *scored.columns, rank.alias("rank"), of.alias("of"), back(best).alias("best_other"), back(F.when(F.col("_step") > F.col("mid"), F.col("mid")).otherwise(F.col("next"))).alias("median_other"),
        F.greatest(F.lit(1), F.round(100 * rank / of)).cast("long").alias("top_percent"),
    )


def warm(pool: DataFrame, postings: dict[str, list[Requirement]], path: str, scorers: list[Scorer] | None = None, text: str = "text") -> None:
    """Write the pool's scores for each posting and scorer as counts, so that one more document is ranked without the pool."""
    scorers = scorers or [Keyword()]
    each = F.array(*(F.struct(F.lit(p).alias("posting_id"), F.lit(s.name).alias("scorer"), F.round(s.score(text, r), 4).alias("score")) for p, r in postings.items() for s in scorers))
    rows = pool.select(F.inline(each)).groupBy("posting_id", "scorer", "score").agg(F.count("*").alias("n"))
    rows.write.mode("overwrite").partitionBy("posting_id").parquet(path)


def warmed(spark: SparkSession, path: str, posting_id: str | None = None) -> DataFrame:
    """(posting_id, scorer, score, n) that warm() wrote; of one posting only its folder is read."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("posting_id") == posting_id) if posting_id is not None else rows


def match(pool: DataFrame, rules: Rules, requirements: list[Requirement], policy: str = "review", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document against one posting: status, reasons and missing rules, score, its place among the others, and the terms found and not found."""
    own = pool.select(F.col(doc_id).alias("doc_id"), outcome(Person.of_columns(), rules, policy).alias("o"), Keyword().explain(text, requirements).alias("e"))
    own = own.select("doc_id", "o.*", F.round("e.score", 4).alias("score"), F.col("e.matched").alias("terms_found"), F.col("e.missing").alias("terms_missing")).persist(StorageLevel.DISK_ONLY)
    return positions(own, "score")


def pool_position(screened: DataFrame, target: DataFrame, score: str) -> DataFrame:
    """For target rows (doc_id, score): rank among the pool's other rows, their upper median, best and number.

    target is a few documents looked at one by one; the pool meets it in one aggregation, without its texts. The
    upper median is the element at n div 2 of the ascending scores: the lower half's successor, never a mean.
    """
    t = target.select(F.col("doc_id").alias("target_id"), F.col(score).alias("own"))
    others = screened.select("doc_id", F.col(score).alias("s")).crossJoin(F.broadcast(t)).where("doc_id <> target_id")
    return others.groupBy("target_id").agg(
        (F.sum((F.col("s") > F.col("own") + TOLERANCE).cast("long")) + 1).alias("rank"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY s DESC)").alias("upper_median"),
        F.max("s").alias("best_other"),
        F.count("*").alias("others"),
    )
