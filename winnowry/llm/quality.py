"""Quality rules: base limits, then robust multivariate outliers by minimum-covariance-determinant estimates.

Statistics of each text (words, symbols, repeated lines and words) become a vector of FEATURES. Every group of one
language and source has its own estimate: STARTS first ones (medians and quartile ranges, mean and covariance of all
vectors, mean and covariance of the vectors between the quartiles in every feature) each take FIRST concentration
steps, in which the share SHARE of the vectors nearest by Mahalanobis distance gives the next mean and covariance. Of
the three the one of least determinant goes on, until no group's estimate moves any more (at most STEPS in all). Texts
farther than the CUTOFF quantile of chi-square are rejected.

Vectors are whole multiples of 1 / UNIT, so that sums are exact and results don't depend on how rows are dealt.
A step is one aggregation: moments by group and by bin of distance (EDGE bins a factor of two), which are dealt by
group and bin; no group's rows ever meet in one task. The nearest share is a prefix of the bins, and of the bin where
it ends all vectors count with the fraction that is missing, so it is exact. The covariance gets FLOOR^2 added on its
diagonal, for most texts have no symbol and no repeat at all and an estimate without width would reject the rest, and
PRIOR texts' worth of the spread within all groups (the mean square of their quartile ranges), so that a group too small
for a covariance of its own (five texts or fewer have none) takes the common spread around its own mean. A group of one
text rejects none.

Nulls: a null text has no words and fails the base; null language or source is a group of its own; a null doc_id is
returned as null. Repeated rows count each; vectors at one distance are in a bin and so are treated alike. A very
long text is one row of arrays, some 100 bytes a word. An empty table gives an empty result. Other columns are
ignored, whatever their names, and kept by keep_good(). All of it is DataFrame operations.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import BROADCAST_ROWS, stash, table, without

WHITE = r" \t\n\x0B\f\r"
WINDOW = 5
SHARE, STARTS, FIRST, STEPS = 0.75, 3, 3, 12
UNIT, EDGE = 1024, 64
#: Texts' worth of the spread within all groups that each group's covariance is drawn towards.
PRIOR = 20
#: Estimates that differ by less have settled.
SETTLED = 1e-9
#: Chance that a text of a normal population is rejected.
CUTOFF = 1e-3
#: Words and letters of an average text that each text's mean word length is drawn towards.
PRIOR_WORDS, PRIOR_CHARS = 30, 150
FEATURES = ("word length", "symbols", "repeated lines", "repeated words")
#: Deviations that a clean text has at least. Symbols: one in a hundred words, an ampersand or a percent sign.
FLOOR = (0.04, 0.1, 0.1, 0.15)
D = len(FEATURES)
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]


def chi_square(x: float, d: int) -> float:
    """Share of the chi-square distribution with an even number d of degrees below x."""
    half, term, total = x / 2, 1.0, 1.0
    for k in range(1, d // 2):
        term *= half / k
        total += term
    return 1 - math.exp(-half) * total


def chi_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, d) < p else (low, mid)
    return low


LIMIT = chi_quantile(1 - CUTOFF, D)
#: Makes the covariance of the nearest share that of the whole, for a normal population.
CONSISTENT = SHARE / chi_square(chi_quantile(SHARE, D), D + 2)


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, lang, source, mark (a hash of what the verdict depends on) and the counts of every whole text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", _mark("lang", "source", "text"))
    keys = ("doc_id", "lang", "source", "mark")
    cut = rows.select(
        *keys,
        F.array_remove(F.split("text", f"[{WHITE}]+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{WHITE}]")).alias("lines"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    word = F.col("words")
    hashes = F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*(word[i + j] for j in range(WINDOW))))
    told = cut.select(
        *keys,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    repeats = F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0)).otherwise(_covered(F.col("windows")))
    return told.select(*keys, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeats.cast("long").alias("n_repeat_words"))


def _mark(lang: Column | str, source: Column | str, text: Column | str) -> Column:
    return F.xxhash64(lang, source, text)


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(sorted_):
        def twice(x, k):
            before = F.when(k > 0, sorted_[k - 1]["h"] == x["h"]).otherwise(False)
            return before | F.when(k < F.size(sorted_) - 1, sorted_[k + 1]["h"] == x["h"]).otherwise(False)

        return F.sort_array(F.transform(F.filter(sorted_, twice), lambda x: x["i"]))

    places = F.transform(F.array(placed), again)[0]
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(places, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")), lambda acc: acc["n"])


def features(stats: DataFrame) -> DataFrame:
    """stats with base_failed and the vector x0.. in whole units."""
    n = F.col("n_words")
    parts = (
        F.log((F.col("word_chars") + PRIOR_CHARS) / (n + PRIOR_WORDS)),
        F.sqrt(F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / n),
        F.sqrt(F.col("n_repeat_words") / n),
    )
    failed = (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)
    return stats.withColumn("base_failed", failed).select("*", *(F.when(~F.col("base_failed"), F.round(p * UNIT).cast("long")).alias(f"x{i}") for i, p in enumerate(parts)))


MEANS, ROOTS = [f"m{i}" for i in range(D)], [f"l{i}{j}" for i, j in PAIRS]
SUMS = [f"s{i}" for i in range(D)] + [f"p{i}{j}" for i, j in PAIRS]


def _pool() -> Column:
    """Language and source as one name."""
    return F.concat(F.coalesce(F.length("lang"), F.lit(-1)), F.lit(":"), F.coalesce("lang", F.lit("")), F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))


def _quartiles(rows: DataFrame) -> DataFrame:
    """pool with its size w, q1_0.. (quartiles) and q2_0.. (medians): from exact counts of each value, which are few."""
    long = rows.select("pool", F.posexplode(F.array(*(f"x{i}" for i in range(D)))).alias("j", "v")).groupBy("pool", "j", "v").count()
    long = stash(long, "counts")  # dealt by value; the running sums below see a row a value
    run = Window.partitionBy("pool", "j")
    long = long.select("pool", "j", "v", F.sum("count").over(run.orderBy("v")).alias("upto"), F.sum("count").over(run).alias("n"))
    at = {k: F.min(F.when(F.col("upto") >= F.col("n") * q, F.col("v"))).alias(k) for k, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))}
    each = long.groupBy("pool", "j").agg(F.max("n").alias("n"), *at.values())
    return each.groupBy("pool").agg(F.max("n").cast("double").alias("w"), *(F.max(F.when(F.col("j") == i, F.col(k))).alias(f"{k}_{i}") for k in at for i in range(D)))


def _spread(i: int) -> Column:
    """Variance that the quartile range of a feature stands for, of a normal population."""
    return F.pow((F.col(f"q3_{i}") - F.col(f"q1_{i}")) / 1.349, 2)


def _starts(rows: DataFrame, quarts: DataFrame, common: list[float], sent: Callable) -> DataFrame:
    """The first estimates: pool, start, means and roots."""
    inside = " AND ".join(f"x{i} BETWEEN q1_{i} AND q3_{i}" for i in range(D))
    both = rows.join(sent(quarts.drop("w")), "pool")
    every = both.groupBy("pool").agg(F.expr("cast(count(*) AS double) AS w"), *_moments(), F.expr(f"cast(count_if({inside}) AS double) AS cw"), *_moments(inside, "c"))
    every = stash(every, "moments")
    core = every.select("pool", F.lit(2).alias("start"), F.col("cw").alias("w"), *(F.col(f"c{n}").alias(n) for n in SUMS)).where("w > 0")
    plain = every.select("pool", F.lit(1).alias("start"), "w", *SUMS)
    spread = [F.sqrt(_spread(i) + F.lit((FLOOR[i] * UNIT) ** 2)) for i in range(D)]
    wide = quarts.select("pool", F.lit(0).alias("start"), *(F.col(f"q2_{i}").cast("double").alias(f"m{i}") for i in range(D)), *((spread[i] if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in PAIRS))
    return wide.unionByName(_roots(plain.unionByName(core), common, 1.0))


# Expressions as text: a step has hundreds of parts, and each would be a call from Python to the planner.
XS = [f"x{i}" for i in range(D)]
#: Coordinates in which the estimate m, l is the standard normal one: the lower triangular root solved row by row.
COORDINATES = [f"(x{i} - m{i}{''.join(f' - l{i}{j} * y{j}' for j in range(i))}) / l{i}{i} AS y{i}" for i in range(D)]
DISTANCE = " + ".join(f"y{i} * y{i}" for i in range(D))
CENTRED = [f"s{i} / w AS m{i}" for i in range(D)] + [f"p{i}{j} / w - s{i} / w * s{j} / w AS c{i}{j}" for i, j in PAIRS]


def _moments(condition: str | None = None, prefix: str = "") -> list[Column]:
    at = lambda c: f"CASE WHEN {condition} THEN {c} END" if condition else c
    return [F.expr(f"sum({at(f'x{i}')}) AS {prefix}s{i}") for i in range(D)] + [F.expr(f"sum({at(f'x{i} * x{j}')}) AS {prefix}p{i}{j}") for i, j in PAIRS]


def _cholesky(common: list[float], consistent: float) -> list[str]:
    """The root of the covariance, row by row."""
    out = []
    for i, j in PAIRS:
        prior, floor = (f" + {common[i] * PRIOR!r}D", f" + {(FLOOR[i] * UNIT) ** 2!r}D") if i == j else ("", "")
        rest = f"((c{i}{j} * w{prior}) / (w + {PRIOR}) * {consistent!r}D{floor}{''.join(f' - l{i}{k} * l{j}{k}' for k in range(j))})"
        out.append(f"sqrt{rest} AS l{i}{j}" if i == j else f"{rest} / l{j}{j} AS l{i}{j}")
    return out


def _roots(near: DataFrame, common: list[float], consistent: float) -> DataFrame:
    """Means and the root of the covariance from weighted moments (w, SUMS) by pool and start. common: the spread within all groups."""
    return near.selectExpr("pool", "start", "w", *CENTRED).selectExpr("pool", "start", *MEANS, *_cholesky(common, consistent))


_PART = "greatest(0D, least(1D, (share - acc.before) / x.n))"
_NEAREST = f"""aggregate(bins, named_struct('before', 0L, 'w', 0D, {", ".join(f"'{c}', 0D" for c in SUMS)}),
 (acc, x) -> named_struct('before', acc.before + x.n, 'w', acc.w + x.n * {_PART}, {", ".join(f"'{c}', acc.{c} + x.{c} * {_PART}" for c in SUMS)}))"""


def _step(rows: DataFrame, now: DataFrame, common: list[float], sent: Callable) -> DataFrame:
    """The estimates from the share of the vectors that is nearest by each of the estimates `now`."""
    far = rows.join(sent(now), "pool").selectExpr("pool", "start", *XS, *COORDINATES)
    bins = far.selectExpr("pool", "start", *XS, f"floor(log2({DISTANCE} + 1e-6D) * {EDGE}) AS bin").groupBy("pool", "start", "bin").agg(F.count("*").alias("n"), *_moments())
    bins = stash(bins, "bins")  # dealt by bin; what follows has a row a group, an array of its bins, some 3,000 at most
    each = bins.groupBy("pool", "start").agg(F.expr(f"sort_array(collect_list(struct(bin, n, {', '.join(SUMS)}))) AS bins"), F.expr(f"sum(n) * {SHARE}D AS share"))
    near = each.selectExpr("pool", "start", f"{_NEAREST} AS near").selectExpr("pool", "start", "near.*")
    return _roots(near, common, CONSISTENT)  # a few rows: computed from the bins where it is needed


def _best(now: DataFrame) -> DataFrame:
    """Of each group's estimates the one of least determinant, the first of equals, as its only one."""
    size = sum((F.log(f"l{i}{i}") for i in range(D)), F.lit(0.0))
    best = now.groupBy("pool").agg(F.min_by(F.struct(*MEANS, *ROOTS), F.struct(F.round(size, 6), "start")).alias("e"))
    return best.select("pool", F.lit(0).alias("start"), "e.*")


def _moved(now: DataFrame, before: DataFrame) -> float:
    """The greatest change of any estimate's mean or root: one number."""
    names = [*MEANS, *ROOTS]
    both = now.join(before.toDF("pool", "start", *(f"_{n}" for n in names)), ["pool", "start"])
    return both.agg(F.max(F.greatest(*(F.abs(F.col(n) - F.col(f"_{n}")) for n in names)))).first()[0] or 0.0


def estimates(rows: DataFrame) -> DataFrame:
    """pool, mean and root of the covariance: of each group's settled estimates the one of least determinant."""
    quarts = stash(_quartiles(rows), "quartiles")
    # Groups are counted: while their estimates fit a broadcast, vectors stay where they are and only sums are dealt.
    sent = F.broadcast if STARTS * quarts.count() <= BROADCAST_ROWS else lambda table: table
    # One row: the mean of the groups' spreads, by their sizes.
    common = [v or 0.0 for v in quarts.agg(*(F.sum(F.col("w") * _spread(i)) / F.sum("w") for i in range(D))).first()]
    now = _starts(rows, quarts, common, sent)
    for turn in range(STEPS):
        now, before = _step(rows, now, common, sent), now
        if turn + 1 == FIRST:
            now = _best(now)
        elif turn > FIRST and turn % 2 == 0 and _moved(now, before) < SETTLED * UNIT:
            break
    return sent(stash(now.drop("start"), "estimate"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """For each row its statistics, base_failed, distance (squared, null if it failed the base) and kept."""
    stats = stash(features(statistics(docs, doc_id, text, lang, source)).withColumn("pool", _pool()), "statistics")
    passed = stats.where(~F.col("base_failed"))
    best = estimates(passed.select("pool", *(f"x{i}" for i in range(D))))
    out = passed.join(best, "pool").selectExpr("*", *COORDINATES).selectExpr("*", f"{DISTANCE} AS distance").withColumn("kept", F.col("distance") <= LIMIT)
    columns = ["doc_id", "mark", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    failed = stats.where("base_failed").select(*columns, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return out.select(*columns, "distance", "kept").unionByName(failed)


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that are kept, with all their columns. Rows go by doc_id, language, source and text."""
    gone = judge(docs, doc_id, text, lang, source).where(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("mark").alias("_mark")).distinct()
    own = lambda d: _mark(d[lang], d[source], F.coalesce(d[text], F.lit("")))
    return without(docs, gone, lambda d, g: d[doc_id].eqNullSafe(g["_gone"]) & (own(d) == g["_mark"]))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, whether it fails the base, and whether it is kept."""
    return judge(table(spark, sf_dir, "documents")).drop("distance", "mark")


QUERIES = {"op1_quality_rules": op1_quality_rules}


def _sql() -> str:
    """The same rows from an engine without arrays of hashes: windows are rows, each step a query on the one before."""
    space = r"[^\x20\x09-\x0D]+"
    stats = f"""docs AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
cut AS (SELECT *, regexp_extract_all(t, '{space}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{space}')) AS l FROM docs),
win AS (SELECT r, k, array_to_string(w[k:k + {WINDOW - 1}], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS k FROM cut)),
twice AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT k + j) AS n FROM twice, range(0, {WINDOW}) t(j) GROUP BY r),
stat AS (SELECT r, doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
 (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM cut LEFT JOIN rep USING (r)),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM stat),"""
    named = f"""v AS (SELECT *, concat(coalesce(length(lang), -1), ':', coalesce(lang, ''), coalesce('=' || source, '-')) AS pool,
 round(ln((word_chars + {PRIOR_CHARS}) / (n_words + {PRIOR_WORDS})::DOUBLE) * {UNIT})::BIGINT AS x0, {", ".join(f"round(sqrt({c} / n_words::DOUBLE) * {UNIT})::BIGINT AS x{i + 1}" for i, c in enumerate(("n_symbols", "n_dup_lines", "n_repeat_words")))} FROM base WHERE NOT base_failed),"""
    at = lambda i, q: f"list_sort(list(x{i}))[ceil(count(*) * {q})::BIGINT]"
    quarts = ", ".join(f"{at(i, q)} AS q{k}_{i}" for i in range(D) for k, q in ((1, 0.25), (2, 0.5), (3, 0.75)))
    xs = ", ".join(f"x{i}" for i in range(D))
    sums = ", ".join([f"sum(x{i}) AS s{i}" for i in range(D)] + [f"sum(x{i} * x{j}) AS p{i}{j}" for i, j in PAIRS])
    inside = " AND ".join(f"x{i} BETWEEN q1_{i} AND q3_{i}" for i in range(D))
    means = ", ".join(MEANS)

    def roots(source: str, name: str, consistent: float) -> str:
        """Means and roots from weighted moments."""
        own = ", ".join([f"s{i} / w AS m{i}" for i in range(D)] + [f"p{i}{j} / w - s{i} / w * s{j} / w AS c{i}{j}" for i, j in PAIRS])
        chol = []
        for i, j in PAIRS:
            prior = f" + g{i} * {PRIOR}" if i == j else ""
            rest = f"((c{i}{j} * w{prior}) / (w + {PRIOR}) * {consistent!r}" + (f" + {(FLOOR[i] * UNIT) ** 2!r})" if i == j else ")") + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            chol.append((f"sqrt({rest})" if i == j else f"({rest}) / l{j}{j}") + f" AS l{i}{j}")
        return f"""own{name} AS (SELECT pool, start, w, {own} FROM ({source})),
r{name} AS (SELECT pool, start, {means}, {", ".join(chol)} FROM own{name}, common)"""

    spread = ", ".join((f"sqrt(pow((q3_{i} - q1_{i}) / 1.349::DOUBLE, 2) + {(FLOOR[i] * UNIT) ** 2!r})" if i == j else "0.0::DOUBLE") + f" AS l{i}{j}" for i, j in PAIRS)
    first = f"SELECT pool, 1 AS start, count(*)::DOUBLE AS w, {sums} FROM v GROUP BY pool UNION ALL SELECT pool, 2, count(*)::DOUBLE, {sums} FROM v JOIN quarts USING (pool) WHERE {inside} GROUP BY pool"
    steps = [
        f"quarts AS MATERIALIZED (SELECT pool, count(*)::DOUBLE AS w, {quarts} FROM v GROUP BY pool)",
        f"common AS MATERIALIZED (SELECT {', '.join(f'sum(w * pow((q3_{i} - q1_{i}) / 1.349::DOUBLE, 2)) / sum(w) AS g{i}' for i in range(D))} FROM quarts)",
        roots(first, "s", 1.0),
        f"e0 AS MATERIALIZED (SELECT pool, 0 AS start, {', '.join(f'q2_{i}::DOUBLE AS m{i}' for i in range(D))}, {spread} FROM quarts UNION ALL SELECT pool, start, {means}, {', '.join(ROOTS)} FROM rs)",
    ]
    near = ", ".join(f"(x{i} - m{i}" + "".join(f" - l{i}{j} * y{j}" for j in range(i)) + f") / l{i}{i} AS y{i}" for i in range(D))
    square = " + ".join(f"y{i} * y{i}" for i in range(D))
    size = " + ".join(f"ln(l{i}{i})" for i in range(D))
    for k in range(STEPS):
        parts = ", ".join(f"sum({c} * f) AS {c}" for c in SUMS)
        steps.append(f"""d{k} AS (SELECT pool, start, {xs}, {near}, floor(log2({square} + 1e-6) * {EDGE}) AS bin FROM v JOIN e{k} USING (pool)),
b{k} AS (SELECT pool, start, bin, count(*) AS n, {sums} FROM d{k} GROUP BY ALL),
o{k} AS (SELECT *, sum(n) OVER (PARTITION BY pool, start ORDER BY bin) - n AS before, sum(n) OVER (PARTITION BY pool, start) * {SHARE}::DOUBLE AS share FROM b{k}),
n{k} AS (SELECT *, least(1.0::DOUBLE, (share - before) / n) AS f FROM o{k} WHERE before < share),
{roots(f"SELECT pool, start, sum(n * f) AS w, {parts} FROM n{k} GROUP BY pool, start", str(k), CONSISTENT)},
e{k + 1} AS MATERIALIZED (SELECT * {f"REPLACE (0 AS start) FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY round({size}, 6), start) AS turn FROM r{k}) WHERE turn = 1" if k + 1 == FIRST else f"FROM r{k}"})""")
    columns = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"
    last = f"far AS (SELECT v.*, {near}, {square} AS far FROM v JOIN e{STEPS} USING (pool))"
    return f"WITH {stats}\n{named}\n" + ",\n".join(steps) + f",\n{last}\nSELECT {columns}, far <= {LIMIT!r} AS kept FROM far UNION ALL SELECT {columns}, false FROM base WHERE base_failed"


ORACLES = {"op1_quality_rules": _sql()}
