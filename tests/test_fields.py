import pytest
from pyspark.sql import functions as F

from winnowry.functions import fields as X
from winnowry.functions import text as T
from winnowry.operators import experiments as E
from winnowry.operators import postings as P
from winnowry.operators.taxonomy import Skill, Taxonomy
from winnowry.sources.records import PEOPLE

RESUME = """Mara Ellison-Vey
mara.vey@post.example | (919) 555-0142

Education:
North Valley University Expected May 2026
B.S. in Applied Physics Minor in Art, GPA: 3.71
EXPERIENCE
Lab Intern | Quell Labs  Jun 2024 - Aug 2024
Analyst at Brightwater Co, 01/2023 – Present
Skills
Languages: Python, SQL; C++ •
R
"""


@pytest.fixture(scope="module")
def one(spark):
    return lambda *cols: spark.range(1).select(*cols).first()


def test_parse(spark):
    r = X.parse(spark.createDataFrame([(RESUME,), ("",), (None,)], "text string")).collect()
    a = r[0]
    assert (a.name, a.email, a.phone, a.degree_level, a.field_of_study, a.school, a.grad_date, a.gpa) == ("Mara Ellison-Vey", "mara.vey@post.example", "(919) 555-0142", "BS", "Applied Physics", "North Valley University", "2026-05", 3.71)
    assert a.skills == ["Python", "SQL", "C++", "R"]
    assert [tuple(x) for x in a.experience] == [("Lab Intern", "Quell Labs", "Jun 2024 - Aug 2024"), ("Analyst", "Brightwater Co", "01/2023 – Present")]
    assert all(x.name is None and x.degree_level is None and x.skills == [] for x in r[1:])


def test_heading_on_a_line_with_text_opens_no_section(one):
    s = one(X.sections(F.lit("Education: none\nSKILLS :\nx\nEducation\ny\nskills\nz")).alias("s")).s
    assert s == {"header": "Education: none", "skills": "x\nz", "education": "y"}


@pytest.mark.parametrize(("text", "level"), [("M.S. then Ph.D.", "PHD"), ("bs", None), ("BS, BA", "BS"), ("Bachelor of Arts in X", "BA"), ("phd", "PHD")])
def test_degree_by_level(one, text, level):
    assert one(X.degree_level(F.lit(text)).alias("d")).d == level


@pytest.mark.parametrize(("text", "name"), [("Jo Li", "Jo Li"), ("Jo", None), ("Experience\nJo Li", None), ("jo@x.org Li", None), ("A B C D E", None), ("\n  Ann O'Dell-Ray ", "Ann O'Dell-Ray")])
def test_name(one, text, name):
    assert one(X.name(F.lit(text)).alias("n")).n == name


def test_folds(one):
    assert one(T.unwrap(F.lit("We want a degree in\nPhysics or a related field.\n- Build tools\nand test")).alias("x")).x == "We want a degree in Physics or a related field.\n- Build tools and test"
    assert one(T.sentences(F.lit("Have a B.S. from here. Go now!")).alias("x")).x == ["Have a B.S. from here.", "Go now!"]
    assert one(T.chunks(F.lit("one\ntwo three four\n- a b c d e f g\nend"), 4, 5).alias("x")).x == ["one two three four", "a b c d e", "f g", "end"]
    assert one(T.join_items(F.array(F.lit("Python,"), F.lit("SQL"), F.lit("and R"), F.lit("Go"))).alias("x")).x == ["Python, SQL and R", "Go"]
    assert one(T.join_letters(T.words(F.lit("S K I L L S and T o"))).alias("x")).x == ["SKILLS", "and", "To"]
    assert [one(T.show_date(F.lit("2025-06"), s).alias("x")).x for s in ("short", "numeric", "long", "season")] == ["Jun 2025", "06/2025", "June 2025", "Summer 2025"]
    assert one(T.close(F.lit("Quell Labs (US)"), F.lit("quell labs, Durham NC")).alias("x")).x and not one(T.close(F.lit("a"), F.lit("a b c d e")).alias("x")).x


POSTINGS = [
    ("Minimum GPA of 3.25 required.", "min_gpa", 3.25), ("You hold a 3.0/4.0 GPA.", "min_gpa", 3.0), ("GPA of 1.1 is fine.", "min_gpa", None),
    ("Pursuing a Bachelor's or Master's degree in Biology, Chemical Engineering, or Physics.", "degree_fields", ["Biology", "Chemical Engineering", "Physics"]),
    ("Ph.D. or M.S. degree wanted.", "min_degree_level", "MS"), ("B.S. in Statistics or a related field.", "fields_enforced", False),
    ("Must graduate between May 2026 and June 2027.", "grad_window", ("2026-05", "2027-06")), ("Graduating by Winter 2025.", "grad_window", ("1900-01", "2025-12")),
    ("For the class of 2027.", "grad_window", ("2027-01", "2027-12")), ("Expected graduation in Spring 2026.", "grad_window", ("2026-03", "2026-06")),
    ("Must be authorized to work in the US.", "require_work_authorization", True), ("We are unable to sponsor visas.", "no_sponsorship", True), ("We build tools for people.", "no_sponsorship", False),
]


@pytest.mark.parametrize(("text", "rule", "value"), POSTINGS)
def test_prose_rules(one, text, rule, value):
    got = one(P.prose_rules(F.lit(text)).alias("r")).r[rule]
    assert (tuple(got) if rule == "grad_window" else got) == value


def test_requirements(spark):
    t = Taxonomy((Skill("Python"), Skill("MATLAB"), Skill("SQL", ("databases",)), Skill("Go")))
    text = "Role\nRequirements:\n- Python or MATLAB\n- Degree in SQL\n- ideally Go\nNice to have\n- databases, Python\nWhat you'll do\nwrite Go\nMust have\nGo"
    got = P.requirements(spark.createDataFrame([("j", text)], "posting_id string, text string"), t).orderBy("ord").collect()
    assert [(r.name, r.surface, r.level, r.group) for r in got] == [("Python", "Python", "required", "j-alt1"), ("MATLAB", "MATLAB", "required", "j-alt1"), ("Go", "Go", "required", None), ("SQL", "databases", "preferred", None)]


PERSON = [("p1", "x", "Jo Li", "jo@x.org", "919-555-0100", "Here", ("B.S.", "BS", "Applied Physics", "Harbor University", "Here", "2026-05", 3.5), ["Python", "SQL"], [("Intern", "Quell Labs", "Here", "2024-06", "2024-08", ["Built a rig", "Tested it"])], [("Boat", ["Floats"])], (True, False))]


def test_written_resume_reads_back(spark):
    people = spark.createDataFrame(PERSON, PEOPLE)
    for edit in (None, *E.EDITS):
        r = X.parse(people.select("id", E.plain_resume(people, edit).alias("text"))).first()
        assert (r.name, r.email, r.degree_level, r.field_of_study, r.school, r.grad_date, r.gpa, r.skills) == ("Jo Li", "jo@x.org", "BS", "Applied Physics", "Harbor University", "2026-05", 3.5, ["Python", "SQL"])
        assert r.experience[0].title == "Intern" and r.experience[0].company == "Quell Labs"
    text = people.select(E.plain_resume(people, "all_edits").alias("t")).first().t
    assert text.index("Evaluated it") < text.index("Created a rig") < text.index(E.EXTRA_BULLET)
