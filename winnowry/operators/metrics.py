"""Counts of right and wrong values, F1, votes between extractors, agreement, accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import close, lenient_tokens, let


def scalar_counts(gold: Column, pred: Column, same: Column | None = None) -> Column:
    """struct(tp, fp, fn): a wrong value is both false; nothing against nothing counts nowhere. Values are computed once."""
    number = lambda c: F.coalesce(c, F.lit(False)).cast("long")

    def told(x):
        g, p = x["g"].isNotNull(), x["p"].isNotNull()
        alike = x["g"] == x["p"] if same is None else x["same"]
        miss = g & p & ~alike
        return F.struct(number(g & p & alike).alias("tp"), number(miss | (~g & p)).alias("fp"), number(miss | (g & ~p)).alias("fn"))

    return let(F.struct(gold.alias("g"), pred.alias("p"), *([] if same is None else [same.alias("same")])), told)


def set_counts(gold: Column, pred: Column) -> Column:
    none = F.array().cast("array<string>")

    def told(x):
        return let(F.size(F.array_intersect(x["g"], x["p"])).cast("long"), lambda n: F.struct(n.alias("tp"), (F.size(x["p"]) - n).alias("fp"), (F.size(x["g"]) - n).alias("fn")))

    return let(F.struct(F.array_distinct(F.coalesce(gold, none)).alias("g"), F.array_distinct(F.coalesce(pred, none)).alias("p")), told)


def greedy_counts(gold: Column, pred: Column, same=close) -> Column:
    """Each gold value in turn takes the first value left that is close to it."""

    def step(acc, g):
        place = F.array_position(F.transform(acc["rest"], lambda p: same(g, p)), F.lit(True)).cast("int")
        rest = F.when(place > 0, F.concat(F.slice(acc["rest"], 1, F.greatest(place - 1, F.lit(0))), F.slice(acc["rest"], place + 1, F.size(acc["rest"])))).otherwise(acc["rest"])
        return F.struct((acc["tp"] + (place > 0).cast("long")).alias("tp"), rest.alias("rest"))

    start = F.struct(F.lit(0).cast("long").alias("tp"), pred.alias("rest"))
    return F.aggregate(gold, start, step, lambda a: F.struct(a["tp"].alias("tp"), F.size(a["rest"]).cast("long").alias("fp"), (F.size(gold) - a["tp"]).cast("long").alias("fn")))


def covers(gold: Column, pred: Column) -> Column:
    """All tokens of gold are in pred."""
    return covers_tokens(lenient_tokens(gold), lenient_tokens(pred))


def covers_tokens(g: Column, p: Column) -> Column:
    """covers() of two texts whose tokens are known."""
    return F.size(F.array_except(g, p)) == 0


def prf(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> dict[str, Column]:
    """precision, recall and F1 of summed counts; 0 where there is nothing to divide by."""
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)), F.lit(0.0))
    p, r = part(tp, fp), part(tp, fn)
    return {"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))}


def micro(counts: DataFrame, *by: str) -> DataFrame:
    """Counts and their precision, recall and F1 by group."""
    total = counts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return total.withColumns(prf())


def vote(proposals: DataFrame, *by: str, key: str = "key", value: str = "value", engine: str = "engine_rank") -> DataFrame:
    """For each group the value that most engines propose, by equal keys; then that of the earliest engine. The value is the one its first engine gave."""
    own = proposals.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.count_distinct(engine).alias("votes"), F.min(engine).alias("first"), F.min_by(value, engine).alias("value"))
    place = Window.partitionBy(*by).orderBy(F.desc("votes"), F.asc("first"), F.asc(key))
    return own.withColumn("_n", F.row_number().over(place)).where("_n = 1").select(*by, "value", "votes")


def vote_list(proposals: Column) -> Column:
    """proposals: array by engine of arrays of items. All items of the first engine that has any, then items of later ones that a further engine supports."""

    def alike(a, b):
        return close(a, b) | close(b, a)

    full = F.filter(proposals, lambda p: F.size(p) > 0)
    rest = F.slice(full, 2, F.greatest(F.size(full) - 1, F.lit(0)))

    def add(acc, item):
        known = F.exists(acc, lambda x: alike(x, item))
        backed = F.size(F.filter(full, lambda p: F.exists(p, lambda x: alike(x, item)))) >= 2
        return F.when(~known & backed, F.concat(acc, F.array(item))).otherwise(acc)

    none = F.array().cast("array<string>")
    return F.when(F.size(full) > 0, F.aggregate(F.flatten(rest), F.coalesce(F.get(full, F.lit(0)), none), add)).otherwise(none)


def agreement(values: DataFrame, *by: str, value: str = "value") -> DataFrame:
    """filled, of, and whether all that are filled say the same."""
    return values.groupBy(*by).agg(F.count(value).alias("filled"), F.count("*").alias("of"), (F.count_distinct(value) == 1).alias("agree"))


def accuracy(lines: DataFrame, gold: str, pred: str, *by: str) -> DataFrame:
    """Share of the labelled lines whose label is predicted, and their number."""
    own = lines.where(F.col(gold).isNotNull())
    return own.groupBy(*by).agg(F.avg((F.col(gold) == F.col(pred)).cast("double")).alias("accuracy"), F.count("*").alias("lines"))


def coverage(values: DataFrame, value: str, known: Column, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """The share of known values, and the k most common unknown ones."""
    own = values.withColumn("_known", known)
    return own.agg(F.avg(F.col("_known").cast("double")).alias("share")), own.where(~F.col("_known")).groupBy(value).count().orderBy(F.desc("count"), value).limit(k)


def transitions(rows: DataFrame, before: str, after: str, *by: str) -> DataFrame:
    """Counts of each change."""
    return rows.where(~F.col(before).eqNullSafe(F.col(after))).groupBy(*by, before, after).agg(F.count("*").alias("count"))
