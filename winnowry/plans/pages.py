"""Page layout queries over line items and parts as words and boxes of pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout
from .tables import table

#: Words of pages in two columns. Some documents have words across the middle, some a right column set flush right.
_WORDS = """
SELECT doc_id, page, 600.0D AS width, top, x0,
  CASE WHEN side = 1 AND doc_id % 5 = 1 THEN 560.0D WHEN doc_id % 4 = 0 AND l_suppkey % 97 = 0 THEN x0 + 300.0D ELSE x0 + 120.0D END AS x1
FROM (SELECT l_orderkey % 50 AS doc_id, l_suppkey % 3 AS page, l_linenumber % 2 AS side, l_suppkey, 12.0D * (l_partkey % 60) + 0.9D * (l_linenumber % 3) AS top,
  CASE WHEN l_linenumber % 2 = 0 THEN 50.0D ELSE 320.0D END + l_partkey % 40 AS x0 FROM {l})"""
_W = "(" + _WORDS.replace("0D", "0::DOUBLE").replace("0.9D", "0.9::DOUBLE").format(l="lineitem") + ")"
_ROW = "floor(top / 12)"


def _words(spark, sf_dir) -> DataFrame:
    return spark.sql(_WORDS, l=table(spark, sf_dir, "lineitem"))


def page_gutter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.gutter(_words(spark, sf_dir))


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each row of each page: rows are told by their first word, not by a grid."""
    return layout.row_numbers(_words(spark, sf_dir)).groupBy("doc_id", "page", "row").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def row_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As page_rows, by one fold over a page's lines: words of one height are counted before, since a row is told by heights alone."""
    tops = _words(spark, sf_dir).groupBy("doc_id", "page", "top").agg(F.count("*").alias("n"))
    pages = tops.groupBy("doc_id", "page").agg(F.collect_list(F.struct("top", "n")).alias("w"))
    rows = pages.select("doc_id", "page", F.posexplode(layout.rows_of("w")).alias("row", "r"))
    return rows.select("doc_id", "page", "row", F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"))


def line_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a gutter at 300 would cut."""
    return layout.cuts_a_line(layout.row_numbers(_words(spark, sf_dir)).withColumn("x", F.lit(300.0))).groupBy("doc_id", "page").agg(F.count_if("cuts").alias("cut_rows"))


def right_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the rows of each page's right column are flush right."""
    rows = layout.row_numbers(_words(spark, sf_dir).where("x0 >= 300")).groupBy("doc_id", "page", "row").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    return layout.right_aligned(rows, "doc_id", "page")


_RECTANGLES = "SELECT p_partkey AS box, p_partkey % 20 AS doc_id, p_partkey % 2 AS page, 600.0D AS width, 10.0D * p_size AS x0, 1.0D * (p_partkey % 300) AS top, 10.0D * p_size + 20.0D + 11.0D * p_size AS x1, 1.0D * (p_partkey % 300) + p_size AS bottom FROM {p}"
_TABLES = "SELECT s_suppkey % 20 AS doc_id, s_suppkey % 2 AS page, 3.0D * (s_suppkey % 90) AS x0, 20.0D AS top, 3.0D * (s_suppkey % 90) + 150.0D AS x1, 120.0D AS bottom FROM {s}"
_R, _T = ("(" + x.replace("0D", "0::DOUBLE").format(p="part", s="supplier") + ")" for x in (_RECTANGLES, _TABLES))
_IN = "(a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1 AND (a.top + a.bottom) / 2 BETWEEN b.top AND b.bottom"


def _boxes(spark, sf_dir) -> DataFrame:
    return layout.boxes(spark.sql(_RECTANGLES, p=table(spark, sf_dir, "part")), spark.sql(_TABLES, s=table(spark, sf_dir, "supplier")))


def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("box", "doc_id", "page")


def words_in_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many boxes of each page have their centre in each of its tables."""
    t = spark.sql(_TABLES, s=table(spark, sf_dir, "supplier")).distinct()
    got = layout.in_box(spark.sql(_RECTANGLES, p=table(spark, sf_dir, "part")), t)
    return got.groupBy("doc_id", "page", F.col("b_x0").alias("table_x0")).agg(F.count("*").alias("n"))


def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each brand's letters without the tiny and the white ones."""
    color = F.expr("CASE p_partkey % 6 WHEN 0 THEN array(1.0D) WHEN 1 THEN array(0.97D, 0.97D, 0.96D) WHEN 2 THEN array(0.0D, 0.0D, 0.0D, 0.0D) WHEN 3 THEN array(0.5D) WHEN 4 THEN array(0.0D, 0.0D, 0.0D, 0.9D) ELSE CAST(array() AS array<double>) END")
    one = F.struct("p_partkey", F.substring("p_name", 1, 1).alias("c"), (F.col("p_size") / 4).alias("size"), color.alias("color"))
    own = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", one.alias("x")))).alias("a"))
    return own.select(F.col("p_brand").alias("brand"), F.array_join(F.transform(layout.visible_chars(F.transform("a", lambda y: y["x"])), lambda x: x["c"]), "").alias("letters"))


def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a table of nations, a line each, without the empty ones."""
    cells = F.array("n_name", F.when(F.col("n_nationkey") % 3 == 0, "  ").otherwise(F.col("n_name")), F.when(F.col("n_nationkey") % 4 == 0, F.lit(None)).otherwise(F.lit("x")))
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", cells.alias("c")))), lambda r: r["c"]).alias("t"))
    return rows.select("n_regionkey", layout.table_text("t").alias("text"))


QUERIES = {f.__name__: f for f in (page_gutter, page_rows, row_words, line_cuts, right_aligned, page_boxes, words_in_tables, visible_text, table_lines)}
_ROWS = f"SELECT *, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY {_ROW}) - 1 AS row FROM {_W}"
_CUT = "(max(CASE WHEN x0 < x AND x1 > x THEN 1 ELSE 0 END) = 1 AND (max(CASE WHEN x1 <= x THEN x1 END) IS NOT NULL OR min(CASE WHEN x0 >= x THEN x0 END) IS NOT NULL)) OR coalesce(min(CASE WHEN x0 >= x THEN x0 END) - max(CASE WHEN x1 <= x THEN x1 END) < 8, false)"
ORACLES = {
    "page_gutter": f"""WITH w AS (SELECT *, {_ROW} AS r FROM {_W}), p AS (SELECT doc_id, page, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 20), x AS (SELECT doc_id, page, n, unnest(range(90, 510, 2))::DOUBLE AS x FROM p),
c AS (SELECT x.doc_id, x.page, x.n, x.x, count(*) FILTER (w.x0 - 4 < x.x AND x.x < w.x1 + 4) AS k, count(*) FILTER (w.x1 <= x.x) AS l FROM x JOIN w ON w.doc_id = x.doc_id AND w.page = x.page GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY k, x) AS i FROM c WHERE least(l, n - l - k) >= n * 0.15), b AS (SELECT doc_id, page, x FROM g WHERE i = 1 AND k <= n * 0.01),
rows_ AS (SELECT doc_id, page, x, r, min(w.x0) AS x0, max(w.x1) AS x1 FROM b JOIN w USING (doc_id, page) WHERE w.x0 >= x GROUP BY ALL), flush AS (SELECT doc_id, page FROM rows_ GROUP BY ALL HAVING count(*) >= 3 AND stddev_pop(x1) < stddev_pop(x0) / 2),
cut AS (SELECT DISTINCT doc_id, page FROM (SELECT doc_id, page, r, {_CUT} AS cuts FROM b JOIN w USING (doc_id, page) GROUP BY doc_id, page, r, x) WHERE cuts)
SELECT doc_id, page, x FROM b ANTI JOIN flush USING (doc_id, page) ANTI JOIN cut USING (doc_id, page)""",
    "page_rows": f"SELECT doc_id, page, row, count(*) AS n, min(x0) AS x0, max(x1) AS x1 FROM ({_ROWS}) GROUP BY ALL",
    "row_words": f"SELECT doc_id, page, row, count(*) AS n FROM ({_ROWS}) GROUP BY ALL",
    "line_cuts": f"SELECT doc_id, page, count(*) FILTER (cuts) AS cut_rows FROM (SELECT doc_id, page, {_ROW} AS r, {_CUT} AS cuts FROM (SELECT *, 300.0 AS x FROM {_W}) GROUP BY ALL) GROUP BY ALL",
    "right_aligned": f"SELECT doc_id, page, count(*) >= 3 AND stddev_pop(x1) < stddev_pop(x0) / 2 AS aligned FROM (SELECT doc_id, page, {_ROW} AS r, min(x0) AS x0, max(x1) AS x1 FROM {_W} WHERE x0 >= 300 GROUP BY ALL) GROUP BY ALL",
    "page_boxes": f"SELECT box, doc_id, page FROM {_R} a WHERE x1 - x0 >= 40 AND bottom - top >= 20 AND x1 - x0 <= 0.9 * width AND NOT EXISTS (SELECT 1 FROM {_T} b WHERE a.doc_id = b.doc_id AND a.page = b.page AND {_IN})",
    "words_in_tables": f"SELECT a.doc_id, a.page, b.x0 AS table_x0, count(*) AS n FROM {_R} a JOIN (SELECT DISTINCT * FROM {_T}) b ON a.doc_id = b.doc_id AND a.page = b.page AND {_IN} GROUP BY ALL",
    "visible_text": "SELECT p_brand AS brand, coalesce(string_agg(left(p_name, 1), '' ORDER BY p_partkey) FILTER (p_size >= 16 AND p_partkey % 6 IN (3, 4, 5)), '') AS letters FROM part GROUP BY ALL",
    "table_lines": "SELECT n_regionkey, string_agg(n_name || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE chr(10) || n_name END || CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE chr(10) || 'x' END, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY ALL",
}
