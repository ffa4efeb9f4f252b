"""Resampled intervals: the same resample for every cell, as a table that joins the counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of draws that a broadcast may hold; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def drawn(rows: DataFrame, case: str, n_boot: int, seed: int = 0) -> DataFrame:
    """draws() of the rows' cases, sent to all executors while cases times resamples, which are counted, are few."""
    got = draws(rows, case, n_boot, seed)
    return F.broadcast(got) if rows.select(F.count_distinct(case)).first()[0] * n_boot <= BROADCAST_ROWS else got


def draws(cases: DataFrame, case: str, n_boot: int, seed: int = 0) -> DataFrame:
    """(boot, case, times): how often each case is drawn in each resample of as many cases.

    Distinct cases are numbered in their order, which takes one pass over them alone. Slot j of resample b takes case number hash(seed, b, j) mod n, so any
    engine can repeat it, and every cell of an experiment sees the same draw.
    """
    from pyspark.sql.window import Window

    one = Window.orderBy(case)
    numbered = cases.select(case).distinct().withColumn("_i", F.row_number().over(one) - 1).withColumn("_n", F.count("*").over(Window.partitionBy()))
    slots = numbered.select(F.col("_i").alias("_slot"), "_n").withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    picked = slots.select("boot", pick("boot", "_slot", "_n", seed).alias("_i"))
    return picked.join(numbered.select(case, "_i"), "_i").groupBy("boot", case).agg(F.count("*").alias("times"))


def pick(boot: str, slot: str, n: str, seed: int) -> Column:
    """A number below n by arithmetic on 31-bit integers that all engines share."""
    x = (F.col(boot).cast("long") * 7919 + F.col(slot).cast("long") * 104_729 + F.lit(seed * 31 + 17)) % 2_147_483_647
    x = (x * 48_271) % 2_147_483_647
    x = (x * 48_271 + F.col(boot)) % 2_147_483_647
    return (x % F.col(n)).cast("int")


def sql_pick(boot: str, slot: str, n: str, seed: int) -> str:
    x = f"(({boot}::BIGINT * 7919 + {slot}::BIGINT * 104729 + {seed * 31 + 17}) % 2147483647)"
    return f"((((({x} * 48271) % 2147483647) * 48271 + {boot}) % 2147483647) % {n})"


def bounds(value: str, low: float = 0.025, high: float = 0.975) -> tuple[Column, Column]:
    """Percentiles with linear interpolation."""
    return F.percentile(value, F.lit(low)), F.percentile(value, F.lit(high))


def paired_f1(counts: DataFrame, case: str, cell: list[str], base: Column, n_boot: int = 2000, seed: int = 0, within: list[str] | None = None) -> DataFrame:
    """cell with bounds of F1, and of its drop in % against the base cell of the same group (within) in the same resample."""
    from pyspark.sql.window import Window

    from .metrics import prf

    own = counts.groupBy(*cell, case).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    each = own.join(drawn(counts, case, n_boot, seed), case).groupBy(*cell, "boot").agg(*(F.sum(F.col(c) * F.col("times")).alias(c) for c in ("tp", "fp", "fn"))).withColumns(prf())
    group = Window.partitionBy("boot", *(within or []))
    each = each.withColumn("base", F.max(F.when(base, F.col("f1"))).over(group)).withColumn("drop", 100 * (1 - F.try_divide("f1", "base")))
    f, d = bounds("f1"), bounds("drop")
    return each.groupBy(*cell).agg(f[0].alias("f1_lo"), f[1].alias("f1_hi"), d[0].alias("drop_lo"), d[1].alias("drop_hi"))


def two_level(counts: DataFrame, outer: str, case: str, cell: list[str], n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """As paired_f1 without a base, over groups (outer) drawn first and cases drawn within them."""
    from .metrics import prf

    own = counts.groupBy(*cell, outer, case).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    outer_draws = drawn(counts, outer, n_boot, seed).withColumnRenamed("times", "outer_times")
    each = own.join(drawn(counts, case, n_boot, seed + 1), case).join(outer_draws, ["boot", outer])
    weight = F.col("times") * F.col("outer_times")
    each = each.groupBy(*cell, "boot").agg(*(F.sum(F.col(c) * weight).alias(c) for c in ("tp", "fp", "fn"))).withColumns(prf())
    low, high = bounds("f1")
    return each.groupBy(*cell).agg(low.alias("f1_lo"), high.alias("f1_hi"))


def mean_bounds(rows: DataFrame, case: str, value: str, by: list[str], n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """Bounds of a mean by group; nulls are left out. Cases are drawn over the whole table, so groups stay paired."""
    own = rows.where(F.col(value).isNotNull())
    sums = own.groupBy(*by, case).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    each = sums.join(drawn(own, case, n_boot, seed), case).groupBy(*by, "boot").agg((F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("m"))
    low, high = bounds("m")
    return each.groupBy(*by).agg(low.alias("lo"), high.alias("hi"))


def with_bounds(summary: DataFrame, bounds_: DataFrame, *cell: str) -> DataFrame:
    """A summary with the bounds of the same cells; cells without bounds are left out."""
    return summary.join(bounds_, list(cell))
