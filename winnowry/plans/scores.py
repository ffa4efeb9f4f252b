"""TF-IDF, vector and experiment queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import sql_count
from ..operators import experiments as X
from ..operators import scoring as S
from ..operators.scoring import Keyword
from .screening import POSTING, _sql_score
from .tables import table


def _fitted(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    d, b = S.term_counts(docs), S.term_counts(items, "item_id")
    n = docs.select(F.lit(1).alias("x")).unionAll(items.select(F.lit(1))).agg(F.count("*").alias("n"))
    corpus = d.unionAll(b.withColumn("doc_id", -1 - F.col("doc_id")))
    return d, b, S.fit_idf(corpus, n), n


def tfidf_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    idf = _fitted(spark, sf_dir)[2]
    return idf.select("term", "df", F.round("idf", 6).alias("idf"))


def tfidf_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against each benchmark item, whose texts stand in for postings."""
    d, b, idf, n = _fitted(spark, sf_dir)
    got = S.against_postings(d, b, n)
    if got is None:
        own = S.weigh(b, idf)
        got = S.cosine(S.weigh_against(d, idf, own), own)
    return got.select("doc_id", F.col("posting_id").alias("item_id"), F.round("score", 6).alias("score"))


def tfidf_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that make the score of each document with each item."""
    d, b, idf, n = _fitted(spark, sf_dir)
    got = S.against_postings(d, b, n, 8)
    if got is None:
        own = S.weigh(b, idf)
        got = S.contributions(S.weigh_against(d, idf, own), own)
    return got.select("doc_id", F.col("posting_id").alias("item_id"), F.array_join("terms", "; ").alias("terms"))


def _items(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def vector_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against its label's mean vector."""
    e = _items(spark, sf_dir)
    c = S.mean_vector(e.select("label", S.unit("embedding").alias("v")), "label", "v")
    return e.join(c, "label").select("vec_id", F.round(S.vector_score(S.unit("embedding"), "vector"), 5).alias("score"))


def vector_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.screening import competition_rank

    got = vector_score(spark, sf_dir).join(_items(spark, sf_dir).select("vec_id", "label"), "vec_id")
    got = got.withColumn("score", F.round("score", 3))
    return got.select("vec_id", "score", competition_rank(F.col("score"), F.col("score") > 0, "label").cast("long").alias("rank"))


def centroid_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.mean_vector(_items(spark, sf_dir).select("label", S.unit("embedding").alias("v")), "label", "v")
    return c.select("label", F.posexplode("vector").alias("i", "x")).select("label", "i", F.round("x", 5).alias("x"))


def _scored(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.round(Keyword().score("text", POSTING), 4).alias("before"))


PAIRS = (("the", "zhe"), ("que", "qui"), ("and", "amp"), ("der", "dher"))


def synonym_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that mentions a term: its score and rank with the term's other wording."""
    pairs = spark.createDataFrame(PAIRS, "term string, other string")
    pool = _scored(spark, sf_dir)
    v = X.with_swaps(pool, pairs).withColumn("after", F.round(Keyword().score("swapped", POSTING), 4))
    v = X.changes(v.select("doc_id", "term", "before", "after"))
    got = X.rank_changes(pool, v)
    return got.select("doc_id", "term", "before", "after", F.round("delta", 4).alias("delta"), F.round("rel_delta", 4).alias("rel_delta"), "rank_before", "rank_after")


def synonym_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synonym_delta(spark, sf_dir).groupBy("term").agg(
        F.count("*").alias("cases"), F.round(F.avg("rel_delta"), 4).alias("mean_rel_delta"), F.round(F.avg((F.col("rank_after") > F.col("rank_before")).cast("double")), 4).alias("share_dropped")
    )


def stuffing_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool's score with the posting's terms added three times, visibly and hidden, with and without a reader that drops hidden text."""
    added = X.stuffing("", [r.surface for r in POSTING], "keyword_list")
    ways = ((True, False), (False, False), (False, True))
    # One scan: what is added says by itself which terms it brings, so a text's variants are scored side by side.
    each = F.array(*(F.struct(F.lit(v).alias("visible"), F.lit(d).alias("drop_invisible"), F.round(Keyword().score(X.stuffed("text", "added", v, d), POSTING), 4).alias("after")) for v, d in ways))
    out = _scored(spark, sf_dir).withColumn("added", F.lit(added)).select("before", F.inline(each))
    best = _scored(spark, sf_dir).agg(F.max("before").alias("best"))
    return out.crossJoin(F.broadcast(best)).groupBy("visible", "drop_invisible").agg(
        F.count("*").alias("candidates"), F.round(F.avg((F.col("after") >= F.col("best")).cast("double")), 4).alias("reaches_best"), F.round(F.percentile("after", F.lit(0.5)), 4).alias("median_score"), F.round(F.avg(F.col("after") - F.col("before")), 4).alias("mean_gain")
    )


_BAG = """
words AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\pL\\pM\\pN_][\\pL\\pM\\pN_+#]*'), lambda w: NOT list_contains({stop}, w)) AS w FROM texts),
terms AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM texts)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf GROUP BY term)""".replace("{stop}", "[" + ", ".join(f"'{w}'" for w in S.STOP_WORDS) + "]")
_TEXTS = "texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark)"
_WEIGHED = "raw AS (SELECT doc_id, term, tf * idf AS x FROM tf JOIN idf USING (term)), unit AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS w FROM raw)"
_UNIT = "SELECT vec_id, label, i, embedding[i]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"
_CENTROID = f"u AS ({_UNIT}), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL), c AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM m)"
_VECTOR = f"WITH {_CENTROID}, s AS (SELECT u.vec_id, u.label, round(greatest(0, sum(u.x * c.x)), 5) AS score FROM u JOIN c USING (label, i) GROUP BY ALL)"
_TOTAL = "(SELECT doc_id, text, {} AS before FROM documents)".format(_sql_score(POSTING))


def _swap_sql() -> str:
    """One SELECT a pair: the swap takes the term's hits in its own case, so those in another case are what it has left."""
    from ..operators.scoring import units

    parts = []
    for term, other in PAIRS:
        without, total = [], 0.0
        for u in units(POSTING):
            w = max(r.weight for r in u)
            total += w
            hit = " OR ".join(f"{sql_count('text', r.surface)} > {sql_count('text', term, 3) if r.surface == term else 0}" for r in u)
            without.append(f"CASE WHEN {hit} THEN {w} ELSE 0.0 END")
        parts.append(f"SELECT doc_id, '{term}' AS term, before, round(cast(({' + '.join(without)}) AS DOUBLE) / {total}, 4) AS after FROM p WHERE {sql_count('text', term, 3)} > 0")
    return f"""p AS (SELECT * FROM {_TOTAL}), v AS ({" UNION ALL ".join(parts)}),
r AS (SELECT v.doc_id, v.term, v.before, v.after, 1 + (SELECT count(*) FROM p o WHERE o.before > v.before + 1e-12 AND o.doc_id <> v.doc_id) AS rank_before, 1 + (SELECT count(*) FROM p o WHERE o.before > v.after + 1e-12 AND o.doc_id <> v.doc_id) AS rank_after FROM v),
d AS (SELECT doc_id, term, before, after, round(after - before, 4) AS delta, round((after - before) / nullif(before, 0), 4) AS rel_delta, rank_before, rank_after FROM r)"""


_STUFFED = f"""WITH p AS (SELECT before, 1.0 AS top FROM {_TOTAL}), v AS (
  SELECT true AS visible, false AS drop_invisible, before, top AS after FROM p UNION ALL SELECT false, false, before, top FROM p UNION ALL SELECT false, true, before, before FROM p)
SELECT visible, drop_invisible, count(*) AS candidates, round(avg(CASE WHEN after >= (SELECT max(before) FROM p) THEN 1.0 ELSE 0.0 END), 4) AS reaches_best,
  round(quantile_cont(after, 0.5), 4) AS median_score, round(avg(after - before), 4) AS mean_gain FROM v GROUP BY ALL"""

QUERIES = {f.__name__: f for f in (tfidf_fit, tfidf_score, tfidf_explain, vector_score, vector_rank, centroid_by_label, synonym_delta, synonym_summary, stuffing_gain)}
ORACLES = {
    "tfidf_fit": f"WITH {_TEXTS}, {_BAG} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "tfidf_score": f"WITH {_TEXTS}, {_BAG}, {_WEIGHED} SELECT a.doc_id, -1 - b.doc_id AS item_id, round(sum(a.w * b.w), 6) AS score FROM unit a JOIN unit b USING (term) WHERE a.doc_id >= 0 AND b.doc_id < 0 GROUP BY ALL",
    "tfidf_explain": f"""WITH {_TEXTS}, {_BAG}, {_WEIGHED}, e AS (SELECT a.doc_id, -1 - b.doc_id AS item_id, a.term, row_number() OVER (PARTITION BY a.doc_id, b.doc_id ORDER BY round(a.w * b.w, 9) DESC, a.term) AS n
 FROM unit a JOIN unit b USING (term) WHERE a.doc_id >= 0 AND b.doc_id < 0) SELECT doc_id, item_id, string_agg(term, '; ' ORDER BY n) AS terms FROM e WHERE n <= 8 GROUP BY ALL""",
    "vector_score": f"{_VECTOR} SELECT vec_id, score FROM s",
    "vector_rank": f"{_VECTOR}, t AS (SELECT vec_id, label, round(score, 3) AS score FROM s) SELECT vec_id, score, CASE WHEN score > 0 THEN rank() OVER (PARTITION BY label, score > 0 ORDER BY score DESC) END AS rank FROM t",
    "centroid_by_label": f"WITH {_CENTROID} SELECT label, i - 1 AS i, round(x, 5) AS x FROM c",
    "synonym_delta": f"WITH {_swap_sql()} SELECT * FROM d",
    "synonym_summary": f"WITH {_swap_sql()} SELECT term, count(*) AS cases, round(avg(rel_delta), 4) AS mean_rel_delta, round(avg(CASE WHEN rank_after > rank_before THEN 1.0 ELSE 0.0 END), 4) AS share_dropped FROM d GROUP BY term",
    "stuffing_gain": _STUFFED,
}
