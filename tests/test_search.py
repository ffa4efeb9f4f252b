import math

import pytest

from winnowry.functions.terms import term_pattern
from winnowry.operators import boolean_search as B

DOCS = [("a", "Python and GMP work; python again"), ("b", "MATLAB, gmp\nrecords"), ("c", "Pythonic R code"), ("d", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id string, text string")


@pytest.mark.parametrize(
    ("query", "ids"),
    [('(Python OR MATLAB) AND "GMP"', "ab"), ("Python NOT GMP", ""), ("matlab -python", "b"), ("NOT python", "bcd"), ("r", ""), ("R", "c"), ("NOT NOT python", "a"), ("python or r", "a"), ('"or" OR R', "c"), ("a-b OR R", "c")],
)
def test_matches(docs, query, ids):
    assert sorted(r.doc_id for r in B.search(docs, query).collect()) == list(ids)


def test_scores_and_order(docs):
    got = B.search(docs, "python OR gmp", 1, lambda t: {"gmp": ["gmp", "records"]}.get(t, [t])).collect()
    assert [(r.doc_id, r.score, r.term_counts) for r in got] == [("a", round(2 + math.log(2), 4), {"python": 2, "gmp": 1})]
    assert [r.doc_id for r in B.search(docs, "NOT python").collect()] == ["b", "c", "d"]


def test_a_page_holds_one_to_fifty(docs):
    assert B.page_of_results(docs, "NOT python", 0).count() == 1 and B.page_of_results(docs, "NOT python", 1000).count() == 3


@pytest.mark.parametrize("query", ["", "(a", "AND a", "a )", ")", "a OR", '""', "NOT", 'a "b'])
def test_errors(query):
    with pytest.raises(B.QueryError):
        B.parse(query)


def test_precedence():
    t = lambda x: B.Node("term", x)
    both = lambda *x: B.Node("and", parts=x)
    assert B.parse("a OR b c") == B.Node("or", parts=(t("a"), both(t("b"), t("c"))))
    assert B.parse("not a AND b") == both(B.Node("not", parts=(t("a"),)), t("b"))
    assert B.symbols('-"x y" -z a-b (or)') == [("NOT", "-"), ("term", "x y"), ("NOT", "-"), ("term", "z"), ("term", "a-b"), ("(", "("), ("OR", "or"), (")", ")")]
    assert B.positive_terms(B.parse("a -b NOT (c NOT d) a")) == ["a", "d"]


def test_patterns(spark):
    rows = spark.createDataFrame([("C++ and c# naïve GD&T x.C",)], "t string")
    hit = lambda term: rows.where(rows.t.rlike(term_pattern(term))).count() == 1
    assert [hit(x) for x in ("C++", "C", "c#", "na", "GD&T", "gd&t", "GD", "x.C")] == [True, True, True, False, True, True, False, True]
    with pytest.raises(ValueError):
        term_pattern(" ")


def test_every_item_is_explained(spark):
    """Each document and item with a score has terms, whatever the item's number."""
    from winnowry.plans import scores

    sf = "/root/testdata/sf0.001"
    pairs = {(r.doc_id, r.item_id) for r in scores.tfidf_explain(spark, sf).collect()}
    assert pairs == {(r.doc_id, r.item_id) for r in scores.tfidf_score(spark, sf).collect()}
    assert any(i >= 3 for _, i in pairs)
