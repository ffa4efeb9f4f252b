import pytest
from pyspark.sql import functions as F

from winnowry.operators.knockouts import Person, Rules, outcome, rule_table
from winnowry.operators.scoring import Keyword, Requirement, term_list
from winnowry.operators.screening import in_order, pool_position, rank_of, screen
from winnowry.operators.taxonomy import Skill, Taxonomy

SCHEMA = "doc_id int, grad_date string, gpa double, degree_level string, field_of_study string, work_authorized boolean, needs_sponsorship boolean, text string"
PEOPLE = [
    (1, "2026-05", 3.5, "BS", "Applied Physics", True, False, "Python and SQL"),
    (2, None, 3.0, "PHD", "physics", None, None, "matlab"),
    (3, "2031-01", 2.0, "BA", "Art", False, True, "Python SQL MATLAB spark"),
    (4, "2026-01", None, None, None, None, False, None),
]
RULES = Rules(("2025-01", "2027-12"), 2.5, "BS", ("Physics",), True, True)


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, SCHEMA)


@pytest.mark.parametrize(("policy", "status"), [("review", ["PASS", "REVIEW", "REJECT", "REVIEW"]), ("reject", ["PASS", "REJECT", "REJECT", "REJECT"]), ("pass", ["PASS", "PASS", "REJECT", "PASS"])])
def test_policies(people, policy, status):
    got = people.select("doc_id", outcome(Person.of_columns(), RULES, policy).alias("o")).orderBy("doc_id").collect()
    assert [r.o.status for r in got] == status
    assert got[2].o.reasons == ["graduation date 2031-01 outside 2025-01..2027-12", "GPA 2.00 below 2.50", "field of study 'Art' not in accepted list", "not authorized to work", "requires visa sponsorship"]
    assert got[3].o.missing == ["GPA", "degree", "field of study"]
    assert got[3].o.reasons == (["missing GPA", "missing degree", "missing field of study"] if policy == "reject" else [])


def test_no_rules(people):
    assert {r.o.status for r in people.select(outcome(Person.of_columns(), Rules()).alias("o")).collect()} == {"PASS"}
    with pytest.raises(ValueError):
        outcome(Person.of_columns(), Rules(), "maybe")


def test_rule_table_asks_for_answers(people):
    rows = people.where("doc_id = 2").select(F.inline(rule_table(Person.of_columns(), RULES))).collect()
    assert [(r.rule, r.status) for r in rows] == [("Degree", "pass"), ("Field of study", "pass"), ("GPA", "pass"), ("Graduation", "missing"), ("Work authorization", "ask"), ("Visa sponsorship", "ask")]


POSTING = [Requirement("Python", "Python", group="g"), Requirement("MATLAB", "MATLAB", group="g"), Requirement("SQL", "SQL", "preferred"), Requirement("spark", "spark", "preferred", curated=False)]


def test_keyword_counts_alternatives_once(people):
    got = {r.doc_id: r.e for r in people.select("doc_id", Keyword().explain("text", POSTING).alias("e")).collect()}
    assert got[1].score == pytest.approx(3 / 3.5) and got[2].score == pytest.approx(2 / 3.5) and got[3].score == 1 and got[4].score == 0
    assert got[1].matched == ["Python / MATLAB", "SQL"] and got[1].missing == ["spark"]
    assert people.select(Keyword().score("text", []).alias("s")).first().s == 0


def test_taxonomy_credit(people):
    t = Taxonomy((Skill("database", ("db",)), Skill("SQL", (), "x", "database")))
    need = [Requirement("database", "database")]
    score = lambda s: {r.doc_id: r.s for r in people.select("doc_id", s.score("text", need).alias("s")).collect()}
    assert score(Keyword())[1] == 0 and score(Keyword(t))[1] == 1
    assert t.canonical("DB") is None and t.canonical("db") == "database" and t.canonical("sql") == "SQL" and t.expand("db") == ["db", "database"]


def test_ranks_leave_out_rejected(people):
    got = in_order(screen(people, RULES, POSTING)).collect()
    assert [(r.doc_id, r.rank_keyword) for r in got] == [(1, 1), (2, 2), (4, 3), (3, None)]


def test_rank_in_pool_and_position(spark):
    s = spark.createDataFrame([(i, v) for i, v in enumerate([0.5, 0.9, 0.5, 0.1, 0.9 + 1e-14])], "doc_id int, s double")
    assert [r.rank_in_pool for r in rank_of(s, "s").orderBy("doc_id").collect()] == [3, 1, 3, 5, 1]
    got = pool_position(s, s.where("doc_id = 0"), "s").first()
    assert (got["rank"], got.best_other, got.others) == (3, pytest.approx(0.9), 4)
    assert got.upper_median == pytest.approx(0.9)  # the upper of 0.1, 0.5, 0.9, 0.9


def test_stop_words_go_before_pairs(spark):
    rows = spark.createDataFrame([("The cat and C++ of dogs",), ("",)], "t string")
    assert [r.x for r in rows.select(term_list("t").alias("x")).collect()] == [["cat", "c++", "dogs", "cat c++", "c++ dogs"], []]
