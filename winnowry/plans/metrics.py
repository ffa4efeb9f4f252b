"""Evaluation, voting, resampling and relational queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import close_tokens, lenient_tokens
from ..operators import bootstrap as B
from ..operators import metrics as M
from ..operators import sampling
from ..operators.experiments import against_baseline
from .tables import table

# Word of each language that three simple extractors look for; the value is the language they name.
ENGINES = ({"en": " the ", "fr": " les ", "de": " der ", "es": " los "}, {"en": " and ", "fr": " et ", "de": " und ", "es": " que "}, {"fr": "é", "de": "ü", "es": "ó", "en": " of "})
FIELDS = ("lang", "length_class")
N_BOOT = 200


def _pred(engine: dict[str, str]):
    out = None
    for lang, word in engine.items():
        hit = F.contains("text", F.lit(word))
        out = F.when(hit, lang) if out is None else out.when(hit, lang)
    return out


def _sql_pred(engine: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN contains(text, '{w}') THEN '{lang}'" for lang, w in engine.items()) + " END"


def _counts(spark, sf_dir) -> DataFrame:
    """A row of tp, fp, fn for each document, engine and field."""
    docs = table(spark, sf_dir, "documents")
    each = docs.select("doc_id", "source", F.explode(F.array(*(F.struct(F.lit(i).alias("engine"), F.col("lang").alias("gold"), _pred(e).alias("pred")) for i, e in enumerate(ENGINES)))).alias("e"))
    return each.select("doc_id", "source", "e.engine", M.scalar_counts(F.col("e.gold"), F.col("e.pred")).alias("c")).select("doc_id", "source", "engine", "c.*")


_COUNTS = "c AS (" + " UNION ALL ".join(
    f"""SELECT doc_id, source, {i} AS engine, (coalesce(lang = p, false))::BIGINT AS tp, (p IS NOT NULL AND coalesce(lang <> p, lang IS NULL))::BIGINT AS fp,
 (lang IS NOT NULL AND coalesce(lang <> p, p IS NULL))::BIGINT AS fn FROM (SELECT *, {_sql_pred(e)} AS p FROM documents)""" for i, e in enumerate(ENGINES)) + ")"  # fmt: skip
_PRF = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def micro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.micro(_counts(spark, sf_dir), "engine"), "precision", "recall", "f1")


def f1_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.micro(_counts(spark, sf_dir), "engine", "source"), "precision", "recall", "f1")


def pivot_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _rounded(M.micro(_counts(spark, sf_dir), "engine", "source"), "f1")
    return got.groupBy("source").pivot("engine", [0, 1, 2]).agg(F.first("f1")).toDF("source", "engine_0", "engine_1", "engine_2")


def baseline_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of each engine by source, and its drop from that of engine 0 on the same source."""
    got = M.micro(_counts(spark, sf_dir), "engine", "source").withColumn("engine", F.concat(F.lit("e"), "engine"))
    got = against_baseline(got, ["source"], "engine", ["f1"], "e0")
    return got.select("source", "engine", F.round("f1", 6).alias("f1"), F.round(100 * (1 - F.try_divide("f1", "f1_e0")), 4).alias("drop"))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang", _pred(ENGINES[0]).alias("pred")).agg(F.count("*").alias("n"))


def skill_set_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of neighbouring documents' words against each other: sizes of what is shared and what isn't."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    other = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("w").alias("v"))
    return docs.join(other, "doc_id").select("doc_id", M.set_counts(F.col("w"), F.col("v")).alias("c")).select("doc_id", "c.*")


def vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = docs.select("doc_id", F.explode(F.array(*(F.struct(F.lit(i).alias("engine_rank"), _pred(e).alias("value")) for i, e in enumerate(ENGINES)))).alias("p")).select("doc_id", "p.*")
    return M.vote(own.withColumn("key", F.lower("value")), "doc_id")


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = docs.select("doc_id", F.explode(F.array(*(_pred(e) for e in ENGINES))).alias("value"))
    return M.agreement(own, "doc_id")


def vote_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of three readers of each document, merged: each reads about half of it, from the start, the middle and up to the end.

    A word is one token, so that words are alike if they are equal but for case; this gives what metrics.vote_list does,
    by sets of whole texts.
    """
    w = F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z ]+", " "), " +"), lambda x: F.length(x) > 3)
    docs = table(spark, sf_dir, "documents").select("doc_id", w.alias("w"))
    part = lambda a, b: F.slice("w", F.floor(F.size("w") * a / 11).cast("int") + 1, F.ceil(F.size("w") * (b - a) / 11).cast("int"))
    lists = docs.select("doc_id", part(0, 6).alias("first"), part(3, 9).alias("second"), part(7, 11).alias("third"))
    lower = lambda c: F.split(F.lower(F.array_join(c, " ")), " ")
    keys = lists.select("doc_id", "first", "second", lower("second").alias("k"), F.array_except(F.array_intersect(lower("second"), lower("third")), lower("first")).alias("more"))
    added = F.transform("more", lambda x: F.get("second", F.array_position("k", x).cast("int") - 1))
    return keys.select("doc_id", F.array_join(F.when(F.size("second") > 0, F.concat("first", added)).otherwise(F.col("first")), " ").alias("items"))


def lenient_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy matches of the lines of neighbouring documents, by their tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x: lenient_tokens(x)).alias("g"))
    other = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("g").alias("p"))
    return docs.join(other, "doc_id").select("doc_id", M.greedy_counts(F.col("g"), F.col("p"), close_tokens).alias("c")).select("doc_id", "c.*")


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", _pred(ENGINES[0]).alias("before"), _pred(ENGINES[1]).alias("after"))
    return M.transitions(docs, "before", "after", "source")


def label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return _rounded(M.accuracy(docs.withColumn("pred", (F.col("n_chars") > 1000).cast("int")), "quality", "pred", "source"), "accuracy")


def heading_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most common first lines that aren't known."""
    docs = table(spark, sf_dir, "documents").select(F.get(F.split("text", "\n"), F.lit(0)).alias("line"))
    return M.coverage(docs, "line", F.length("line") > 30, 10)[1]


def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named aggregates: sizes, conditional counts, means, exact and upper medians, distinct groups."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"),
        F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.round(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value DESC)"), 6).alias("upper_median"), F.count_distinct("user_id").alias("users"),
    )


def bootstrap_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("value", F.col("n_chars").cast("double"))
    return _rounded(B.mean_bounds(docs, "source", "value", ["lang"], N_BOOT), "lo", "hi")


def paired_bootstrap_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = B.paired_f1(_counts(spark, sf_dir), "source", ["engine"], F.col("engine") == 0, N_BOOT)
    return _rounded(got, "f1_lo", "f1_hi", "drop_lo", "drop_hi")


def two_level_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _counts(spark, sf_dir).withColumn("outer", F.col("doc_id") % 5).withColumn("case", F.col("doc_id") % 12)
    return _rounded(B.two_level(c, "outer", "case", ["engine"], N_BOOT), "f1_lo", "f1_hi")


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified(table(spark, sf_dir, "documents"), "lang", "doc_id", 5, 7).select("doc_id", "lang")


def union_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, and those with a label as a second pool that takes their place."""
    d = table(spark, sf_dir, "documents")
    first = d.select("doc_id", F.lit("first").alias("origin"), "n_chars")
    second = d.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", F.lit("second").alias("origin"), "n_chars")
    return sampling.unite(first, second, "doc_id")


def newest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.newest(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", 100)


def join_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an order, and without one."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").select("c_custkey", F.lit("has").alias("kind")).unionAll(c.join(o, "c_custkey", "left_anti").select("c_custkey", F.lit("none")))


def rank_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.screening import competition_rank

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", -3).alias("price"))
    return o.select("o_orderkey", competition_rank(F.col("price"), F.col("o_orderstatus") != "P", "o_custkey").cast("long").alias("rank"))


def pivot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).select("o_orderpriority", *(F.coalesce(c, F.lit(0)).alias(f"n_{c}") for c in "FOP"))


def nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equi joins with small dimensions, and an aggregate above them."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def cross_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of two small dimensions, with what there is of it."""
    t = lambda n: table(spark, sf_dir, n)
    keys = t("nation").select("n_nationkey").crossJoin(t("customer").select("c_mktsegment").distinct())
    own = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg(F.count("*").alias("n"))
    return keys.join(own, ["n_nationkey", "c_mktsegment"], "left").select("n_nationkey", "c_mktsegment", F.coalesce("n", F.lit(0)).alias("n"))


def dates_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as prose, and the months read back from it."""
    from ..functions.fields import all_dates

    o = table(spark, sf_dir, "orders")
    said = F.concat(F.date_format("o_orderdate", "MMM yyyy"), F.lit(" until "), F.date_format(F.add_months("o_orderdate", 5), "MM/yyyy"), F.lit(" or "), F.date_format("o_orderdate", "MMMM yyyy"))
    return o.select("o_orderkey", F.array_join(all_dates(said), " ").alias("months"), F.array_max(all_dates(said)).alias("latest"))


QUERIES = {
    f.__name__: f
    for f in (micro_f1, f1_by_source, pivot_f1, baseline_join, confusion, skill_set_counts, vote, agreement, vote_list, lenient_counts, transitions, label_accuracy, heading_coverage, summary_stats, bootstrap_mean, paired_bootstrap_drop, two_level_bootstrap, stratified_sample, union_pool, newest_rows, join_semi_anti, rank_orders, pivot_status, nation_revenue, cross_dimensions, dates_roundtrip)
}


def _draws(cases: str, seed: int = 0) -> str:
    return f"""(SELECT b.boot, k.c AS c, count(*) AS times FROM (SELECT boot, {B.sql_pick("boot", "slot", "n", seed)} AS i FROM
 (SELECT unnest(range({N_BOOT})) AS boot), (SELECT i AS slot, n FROM {cases})) b JOIN {cases} k ON k.i = b.i GROUP BY ALL)"""


_CASES = "(SELECT c, row_number() OVER (ORDER BY c) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT {} AS c FROM {}))"
_ROUND = "engine, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"
ORACLES = {
    "micro_f1": f"WITH {_COUNTS}, s AS (SELECT engine, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY engine), p AS (SELECT *, {_PRF} FROM s) SELECT {_ROUND} FROM p",
    "f1_by_source": f"WITH {_COUNTS}, s AS (SELECT engine, source, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY ALL), p AS (SELECT *, {_PRF} FROM s) SELECT source, {_ROUND} FROM p",
    "pivot_f1": f"WITH {_COUNTS}, s AS (SELECT engine, source, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c GROUP BY ALL), p AS (SELECT *, {_PRF} FROM s) SELECT source, "
    + ", ".join(f"max(CASE WHEN engine = {i} THEN round(f1, 6) END) AS engine_{i}" for i in range(3)) + " FROM p GROUP BY source",
    "baseline_join": f"WITH {_COUNTS}, s AS (SELECT engine, source, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c GROUP BY ALL), p AS (SELECT *, {_PRF} FROM s) SELECT a.source, 'e' || a.engine AS engine, round(a.f1, 6) AS f1, round(100 * (1 - a.f1 / nullif(b.f1, 0)), 4) AS drop FROM p a JOIN p b ON a.source = b.source AND b.engine = 0",
    "confusion": f"SELECT lang, {_sql_pred(ENGINES[0])} AS pred, count(*) AS n FROM documents GROUP BY ALL",
    "skill_set_counts": """WITH d AS (SELECT doc_id, list_distinct(string_split(text, ' ')) AS w FROM documents)
SELECT a.doc_id, len(list_intersect(a.w, b.w))::BIGINT AS tp, len(b.w) - len(list_intersect(a.w, b.w)) AS fp, len(a.w) - len(list_intersect(a.w, b.w)) AS fn FROM d a JOIN d b ON b.doc_id + 1 = a.doc_id""",
    "vote": "WITH p AS (" + " UNION ALL ".join(f"SELECT doc_id, {i} AS r, {_sql_pred(e)} AS v FROM documents" for i, e in enumerate(ENGINES)) + """), g AS (SELECT doc_id, v, count(*) AS votes, min(r) AS first FROM p WHERE v IS NOT NULL GROUP BY ALL)
SELECT doc_id, v AS value, votes FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, first, v) AS n FROM g) WHERE n = 1""",
    "vote_list": """WITH a AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '[^A-Za-z ]+', ' ', 'g'), ' +'), lambda x: length(x) > 3) AS w FROM documents), n AS (SELECT doc_id, w, len(w) AS n FROM a),
p AS (SELECT doc_id, w[1:ceil(n * 6 / 11.0)::BIGINT] AS x, w[floor(n * 3 / 11.0)::BIGINT + 1:floor(n * 3 / 11.0)::BIGINT + ceil(n * 6 / 11.0)::BIGINT] AS y, w[floor(n * 7 / 11.0)::BIGINT + 1:floor(n * 7 / 11.0)::BIGINT + ceil(n * 4 / 11.0)::BIGINT] AS z FROM n),
k AS (SELECT doc_id, x, y, list_transform(x, lambda v: lower(v)) AS kx, list_transform(y, lambda v: lower(v)) AS ky, list_transform(z, lambda v: lower(v)) AS kz FROM p)
SELECT doc_id, array_to_string(list_concat(x, list_transform(list_filter(range(1, len(y) + 1), lambda i: list_position(ky, ky[i]) = i AND list_contains(kz, ky[i]) AND NOT list_contains(kx, ky[i])), lambda i: y[i])), ' ') AS items FROM k""",
    "agreement": "WITH p AS (" + " UNION ALL ".join(f"SELECT doc_id, {_sql_pred(e)} AS v FROM documents" for e in ENGINES) + ") SELECT doc_id, count(v) AS filled, count(*) AS of, count(DISTINCT v) = 1 AS agree FROM p GROUP BY doc_id",
    "transitions": f"SELECT source, before, after, count(*) AS count FROM (SELECT source, {_sql_pred(ENGINES[0])} AS before, {_sql_pred(ENGINES[1])} AS after FROM documents) WHERE before IS DISTINCT FROM after GROUP BY ALL",
    "label_accuracy": "SELECT source, round(avg(CASE WHEN quality = (n_chars > 1000)::INT THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS lines FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY source",
    "heading_coverage": "SELECT line, count(*) AS count FROM (SELECT string_split(text, chr(10))[1] AS line FROM documents) WHERE length(line) <= 30 GROUP BY line ORDER BY count DESC, line LIMIT 10",
    "summary_stats": """SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS high, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most, round(quantile_cont(value, 0.5), 6) AS median,
 round(list_sort(list(value))[(count(value) // 2)::INT + 1], 6) AS upper_median, count(DISTINCT user_id) AS users FROM events GROUP BY event_type""",
    "bootstrap_mean": f"""WITH d AS (SELECT source, lang, n_chars::DOUBLE AS v FROM documents), s AS (SELECT lang, source, sum(v) AS s, count(*) AS n FROM d GROUP BY ALL),
m AS (SELECT s.lang, w.boot, sum(s.s * w.times) / sum(s.n * w.times) AS m FROM s JOIN {_draws(_CASES.format("source", "d"))} w ON w.c = s.source GROUP BY ALL)
SELECT lang, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m GROUP BY lang""",
    "paired_bootstrap_drop": f"""WITH {_COUNTS}, s AS (SELECT c.engine, w.boot, sum(tp * w.times) AS tp, sum(fp * w.times) AS fp, sum(fn * w.times) AS fn FROM c JOIN {_draws(_CASES.format("source", "c"))} w ON w.c = c.source GROUP BY ALL),
p AS (SELECT *, {_PRF} FROM s), q AS (SELECT *, max(CASE WHEN engine = 0 THEN f1 END) OVER (PARTITION BY boot) AS base FROM p), r AS (SELECT *, 100 * (1 - f1 / nullif(base, 0)) AS d FROM q)
SELECT engine, round(quantile_cont(f1, 0.025), 6) AS f1_lo, round(quantile_cont(f1, 0.975), 6) AS f1_hi, round(quantile_cont(d, 0.025), 6) AS drop_lo, round(quantile_cont(d, 0.975), 6) AS drop_hi FROM r GROUP BY engine""",
    "two_level_bootstrap": f"""WITH {_COUNTS}, s AS (SELECT c.engine, w.boot, sum(tp * w.times * o.times) AS tp, sum(fp * w.times * o.times) AS fp, sum(fn * w.times * o.times) AS fn FROM c
 JOIN {_draws(_CASES.format("doc_id % 12", "c"), 1)} w ON w.c = c.doc_id % 12 JOIN {_draws(_CASES.format("doc_id % 5", "c"), 0)} o ON o.boot = w.boot AND o.c = c.doc_id % 5 GROUP BY ALL), p AS (SELECT *, {_PRF} FROM s)
SELECT engine, round(quantile_cont(f1, 0.025), 6) AS f1_lo, round(quantile_cont(f1, 0.975), 6) AS f1_hi FROM p GROUP BY engine""",
    "stratified_sample": "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS n FROM documents) WHERE n <= 5",
    "union_pool": "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'second' ELSE 'first' END AS origin, n_chars FROM documents",
    "newest_rows": "SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 100",
    "join_semi_anti": "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'has' ELSE 'none' END AS kind FROM customer",
    "rank_orders": "SELECT o_orderkey, CASE WHEN e THEN rank() OVER (PARTITION BY o_custkey, e ORDER BY p DESC) END AS rank FROM (SELECT o_orderkey, o_custkey, o_orderstatus <> 'P' AS e, round(o_totalprice, -3) AS p FROM orders)",
    "pivot_status": "SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{c}') AS n_{c}" for c in "FOP") + " FROM orders GROUP BY o_orderpriority",
    "nation_revenue": "SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "cross_dimensions": "SELECT n_nationkey, s.c_mktsegment, count(c_custkey) AS n FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s LEFT JOIN customer c ON c_nationkey = n_nationkey AND c.c_mktsegment = s.c_mktsegment GROUP BY ALL",
    "dates_roundtrip": """WITH a AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS x, strftime(o_orderdate + INTERVAL 5 MONTH, '%Y-%m') AS y FROM orders) SELECT o_orderkey, x || ' ' || x || ' ' || y AS months, greatest(x, y) AS latest FROM a""",
}
