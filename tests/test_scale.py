"""Plans that have to hold at size: how work is dealt, and what grows with what."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from winnowry.functions import fields, text
from winnowry.operators import layout

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["layout_counts", "lenient_fields", "resume_fields", "voted_fields"])
def test_people_are_parsed_in_many_tasks(spark, name):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc_id" in plan


def test_texts_at_their_edges(spark):
    ends = spark.createDataFrame([("a\r\r\nb\r\nc\n\rd\n",), ("  \x85x　\n",), ("",), (None,)], "t string")
    got = ends.select(text.lines("t").alias("l"), text.strip(F.col("t")).alias("s"), text.words("t").alias("w")).collect()
    assert got[0].l == ["a", "", "b", "c", "", "d", ""] and got[1].s == "x" and got[1].w == ["x"] and got[2].l == [""] and got[2].w == []
    assert got[3].l is None and got[3].s is None and got[3].w is None
    assert spark.range(1).select(text.normal_heading(F.lit(" Work  Experience :: ")).alias("h")).first().h == "work experience"


def test_sections_of_a_long_text(spark):
    """Lines between two headings are a slice: a text of many lines takes no time for each pair of them."""
    long = "\n".join(f"line {i}" for i in range(20_000)) + "\nSkills\nGo\n\nEducation:\nskills\nSQL"
    got = spark.createDataFrame([(long,)], "t string").select(fields.sections("t").alias("s")).first().s
    assert got["skills"] == "Go\n\nSQL" and "education" not in got and got["header"].count("\n") == 19_999


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_a_page_of_many_words(spark):
    """The words of one height are counted before a page is folded, and the fold grows with the rows alone."""
    plan = _plan(__spark_entry__.queries()["row_words"](spark, SF))
    assert "Aggregate [doc_id" in plan and plan.count("Aggregate [") == 2
    words = [(float(t), float(x)) for t in (5, 0, 1, 2, 3, 40) for x in range(2)]
    got = spark.createDataFrame([(words,), ([],)], "w array<struct<top:double,x0:double>>").select(layout.rows_of("w").alias("r")).collect()
    assert [[w.top for w in r] for r in got[0].r] == [[0, 0, 1, 1, 2, 2], [3, 3, 5, 5], [40, 40]] and got[1].r == []


def test_boxes_meet_words_of_their_tile(spark):
    edges = "x0 double, top double, x1 double, bottom double"
    own = [(d, 0, 100.0, *e) for d, e in ((1, (49.0, 49.0, 51.0, 51.0)), (1, (0.0, 0.0, 2.0, 2.0)), (1, (6000.0, 1.0, 6002.0, 3.0)), (2, (49.0, 49.0, 51.0, 51.0)))]
    words = spark.createDataFrame(own, f"doc_id int, page int, width double, {edges}")
    held = spark.createDataFrame([(1, 0, 50.0, 50.0, 90.0, 90.0), (1, 0, 50.0, 50.0, 90.0, 90.0), (1, 0, 10.0, 0.0, 9000.0, 10.0), (1, 0, 5.0, 9.0, 0.0, 0.0)], f"doc_id int, page int, {edges}")
    assert sorted((r.doc_id, r.x0) for r in layout.in_box(words, held, "left_anti").collect()) == [(1, 0.0), (2, 49.0)]
    assert sorted(r.x0 for r in layout.in_box(words, held).collect()) == [49.0, 49.0, 6000.0]
    assert "_tx" in _plan(__spark_entry__.queries()["page_boxes"](spark, SF))


def test_lines_go_on_as_in_sql(spark):
    """ASCII edges of words and very ends of lines, each line judged by the one before it."""
    texts = ["que chllaía\nEs bueno", "a b,\t\nC d", "one. \nTwo and\n\nthree", "x\n  \ny z", "we want a\nphysics  \nDegree of\nArts"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(text.unwrap("t").alias("u"), text.sentences("t").alias("s")).collect()
    assert [r.u for r in got] == ["que chllaía Es bueno", "a b,\t\nC d", "one. \nTwo and\n\nthree", "x\n  \ny z", "we want a physics\nDegree of Arts"]
    assert got[0].s == ["que chllaía Es bueno"]


def test_postings_are_read_in_many_tasks(spark):
    assert "RepartitionByExpression [id" in _plan(__spark_entry__.queries()["prose_rules"](spark, SF))


def test_topk_asks_for_every_word_of_its_sql(spark, tmp_path):
    """An unquoted "and" is an operator: texts without the word came into the result."""
    spark.createDataFrame([(1, "the of the of"), (2, "The and of"), (3, "and of"), (4, None)], "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r.doc_id, r.score) for r in __spark_entry__.queries()["search_topk"](spark, str(tmp_path)).collect()] == [(2, 2.0)]


def test_scores_shuffle_no_pairs(spark):
    """Documents meet postings in one row; what comes out equals the joins that stay for postings too many to send."""
    from winnowry.operators import scoring as S

    docs = spark.createDataFrame([(1, "red green apples red"), (2, "blue pears"), (3, None), (4, "green pears wanted apples")], "doc_id int, text string")
    items = spark.createDataFrame([(7, "green apples wanted"), (8, "pears red pears")], "doc_id int, text string")
    d, b, n = S.term_counts(docs), S.term_counts(items), spark.range(1).select(F.lit(6).cast("long").alias("n"))
    idf = S.fit_idf(d.unionAll(b.withColumn("doc_id", -F.col("doc_id"))), n)
    own = S.weigh(b, idf)
    want = {(r.doc_id, r.posting_id): r.score for r in S.cosine(S.weigh_against(d, idf, own), own).collect()}
    got = S.against_postings(d, b, n)
    assert {(r.doc_id, r.posting_id): r.score for r in got.collect()} == pytest.approx(want) and len(want) == 5
    assert sorted(map(tuple, S.against_postings(d, b, n, 2).collect())) == sorted(map(tuple, S.contributions(S.weigh_against(d, idf, own), own, 2).collect()))
    assert "posting_id" not in _plan(got).split("MapInArrow")[1].split("\n", 1)[1]
