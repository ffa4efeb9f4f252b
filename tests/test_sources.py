import json
import zipfile

import pytest
from pyspark.sql import functions as F

from winnowry.operators import lines
from winnowry.operators.knockouts import Rules
from winnowry.operators.scoring import Requirement
from winnowry.operators.tagger import Tagger
from winnowry.sources import external, files, html, records
from winnowry.streaming import feeds

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
P = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
BOX = "<w:p><w:r><w:t>anchor</w:t></w:r><w:r><mc:AlternateContent><mc:Choice><w:txbxContent>" + P.format("in box") + "</w:txbxContent></mc:Choice><mc:Fallback><w:txbxContent>" + P.format("in box") + "</w:txbxContent></mc:Fallback></mc:AlternateContent></w:r></w:p>"
TABLE = "<w:tbl><w:tr><w:tc>" + P.format("one") + "</w:tc><w:tc><w:tbl><w:tr><w:tc>" + P.format("deep") + "</w:tc></w:tr></w:tbl>" + P.format("") + "</w:tc></w:tr></w:tbl>"


def docx(path, body):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain é")
    (tmp_path / "b.md").write_text("# mark")
    (tmp_path / "c.html").write_text("<p>Hello <b>you</b></p><script>no</script>")
    docx(tmp_path / "d.docx", P.format("first") + TABLE + BOX)
    (tmp_path / "e.docx").write_text("broken")
    read = lambda aware: {r.path[-6:]: r.text for r in files.read_documents(spark, str(tmp_path), aware).collect()}
    got = read(False)
    assert got["/a.txt"] == "plain é" and got["c.html"] == "Hello\nyou" and got["e.docx"] is None
    assert got["d.docx"] == "first\none\ndeep\nanchor" and read(True)["d.docx"] == "first\none\ndeep\nanchor\nin box"
    (tmp_path / "f.pdf").write_bytes(b"%PDF")
    with pytest.raises(files.UnsupportedFormat):
        files.read_documents(spark, str(tmp_path))


def test_html_events():
    got = html.html_events("<h2 id=work>Work</h2><div id='SECT_1'><p>a<br>b</p><h3>T</h3></div><p>end")
    assert [(e["text"], e["section"], e["is_heading"]) for e in got] == [("Work", "work", True), ("a", "SECT_1", False), ("b", "SECT_1", False), ("T", "SECT_1", True), ("end", None, False)]
    assert html.html_events(None) == []


def test_records(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"skills": [{"name": "B", "aliases": ["b1"], "category": "x"}, {"name": "A", "aliases": [], "category": "y", "broader": "B"}]}))
    assert [(r["ord"], r["name"], r["broader"]) for r in records.skills(spark, str(tmp_path / "s.json")).collect()] == [(0, "B", None), (1, "A", "B")]
    (tmp_path / "r.csv").write_text('ID,Resume_str,Category\n1,"two\nlines  ""q""",HR\n2,x,IT\n3,y,hr\n')
    got = {r.id: r.text for r in records.resumes_csv(spark, str(tmp_path / "r.csv"), ["hr"]).collect()}
    assert got == {"public-1": 'two lines "q"', "public-3": "y"}
    assert records.resumes_csv(spark, str(tmp_path / "r.csv"), per_category=1).count() == 3
    own = spark.createDataFrame([("1", ["a"], ["name"], [[1.0, 2.0]]), ("1", ["a"], ["name"], [[1.0]])], records.LABELS)
    records.export_labels(own, str(tmp_path / "labels"))
    assert sorted(r.geometry is None for r in records.exported_labels(spark, str(tmp_path / "labels"), 2).collect()) == [False, True]


def test_external_parsers(spark):
    import sys

    code = "import sys, json\nfor f in sys.argv[1:]: print(json.dumps({'file': f, 'n': len(f)})); print('noise')"
    got = external.run_jsonl([sys.executable, "-c", code], spark.createDataFrame([("ab",), ("c",)], "file string"), 1).collect()
    assert {r.file for r in got} == {"ab", "c"}
    nested = json.dumps({"profile": {"name": "Jo Li", "email": "j@x.org", "phone": "1"}, "educations": [{"school": "Harbor University", "degree": "B.S. in X", "date": "May 2026", "gpa": "3.5"}], "workExperiences": [{"company": "Q", "jobTitle": "T", "date": "2020"}], "skills": {"featuredSkills": [{"skill": "Go (basic)"}, {"skill": ""}]}})
    r = spark.range(1).select(external.from_profile(F.lit(nested)).alias("r")).first().r
    assert (r.name, r.degree_level, r.grad_date, r.gpa, r.skills, r.experience[0].title) == ("Jo Li", "BS", "2026-05", 3.5, ["Go"], "T")
    r = spark.range(1).select(external.from_flat(F.lit('{"name": "Jo", "degree": ["Ph.D."], "designation": ["Lead"], "skills": ["Go"]}')).alias("r")).first().r
    assert (r.name, r.degree_level, r.experience[0].title, r.experience[0].company) == ("Jo", "PHD", "Lead", None)


def test_tagger(spark, tmp_path):
    rows = []
    for d in range(8):
        rows += [(d, 0, f"Jo Li{'abcdefgh'[d]}", "name"), (d, 1, f"jo{d}@x.org", "contact"), (d, 2, "EDUCATION", "heading"), (d, 3, f"B.S. in Physics 202{d}", "education"), (d, 4, "SKILLS", "heading"), (d, 5, f"Python, SQL, C{d}", "skills")]
    table = spark.createDataFrame(rows, "doc_id int, line_no int, line string, label string")
    t = Tagger.fit(table.where("doc_id < 6"), passes=15)
    got = t.predict(table.where("doc_id >= 6")).join(table, ["doc_id", "line_no"]).collect()
    assert sum(r.predicted == r.label for r in got) >= 11
    t.save(str(tmp_path / "m"))
    again = Tagger.load(str(tmp_path / "m"))
    assert {tuple(r) for r in again.predict(table.where("doc_id = 7")).collect()} == {tuple(r) for r in t.predict(table.where("doc_id = 7")).collect()}
    assert Tagger.load(str(tmp_path / "none")) is None
    labelled = lines.labelled_sections(table.where("doc_id = 0")).first()
    assert labelled["name"] == "Jo Lia" and labelled.sections["education"] == "B.S. in Physics 2020"


def test_streams(spark, tmp_path):
    schema = "doc_id int, grad_date string, gpa double, degree_level string, field_of_study string, work_authorized boolean, needs_sponsorship boolean, text string"
    spark.createDataFrame([(1, None, 3.0, None, None, None, None, "Python"), (2, None, 1.0, None, None, None, None, "none")], schema).write.parquet(str(tmp_path / "in"))
    pool = feeds.pool_steps(spark.createDataFrame([(1.0,), (0.5,), (0.5,), (0.0,)], "score double"))
    out = feeds.score_arrivals(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), Rules(min_gpa=2.0), [Requirement("Python", "Python"), Requirement("Go", "Go")], pool)
    q = out.writeStream.format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.doc_id, r.status, r.score, r.better) for r in spark.table("arrivals").collect()} == {(1, "PASS", 0.5, 1), (2, "REJECT", 0.0, 3)}
    seen = []
    feeds.learn_from(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda b, n: seen.append((n, b.count())), str(tmp_path / "k")).awaitTermination(120)
    assert seen == [(0, 2)]


def test_section_codes():
    page = "<div>Jo</div><div id='SECTION_NAME1'>Jo Li</div><div id='SECTION_EXPR2'><div class='x sectiontitle'>Work</div><p>did it</p></div><div id='SECTION_ZZZZ'>more</div>"
    assert html.section_events(page) == [("Jo", None), ("Jo Li", None), ("Work", "heading"), ("did it", "experience"), ("more", "other")]
    assert html.section_events(None) == []


def test_docx_geometry(spark, tmp_path):
    from winnowry.operators.tagger import GEOMETRY

    run = "<w:r><w:rPr>{}</w:rPr><w:t>{}</w:t></w:r>"
    body = "<w:p><w:pPr><w:jc w:val='center'/></w:pPr>" + run.format("<w:sz w:val='44'/><w:b/>", "Jo Li") + "</w:p>"
    body += "<w:p><w:pPr><w:pStyle w:val='Heading1'/><w:spacing w:before='240'/></w:pPr>" + run.format("<w:color w:val='FF0000'/>", "WORK") + "</w:p>"
    body += "<w:p><w:pPr><w:ind w:left='720'/></w:pPr>" + run.format("<w:i/>", "a b") + run.format("", " long plain") + "</w:p>" + P.format("x") + TABLE + BOX
    docx(tmp_path / "g.docx", body)
    docx(tmp_path / "h.docx", "")
    (tmp_path / "i.docx").write_text("broken")
    rows = spark.read.format("binaryFile").load(str(tmp_path)).select("path", files.docx_geometry("content").alias("g")).collect()
    got = {r.path[-6:]: None if r.g is None else [(x.line, dict(zip(GEOMETRY, x.geometry))) for x in r.g] for r in rows}
    assert got["i.docx"] is None and got["h.docx"] == []
    name, head, item, *rest = got["g.docx"]
    assert name[0] == "Jo Li" and name[1]["is_largest"] == name[1]["bold"] == name[1]["centered"] == 1 and name[1]["size_ratio"] == pytest.approx(2 / 3)
    assert head[1]["rule_below"] == head[1]["colored"] == 1 and head[1]["gap_above"] == pytest.approx(12 / 11 / 4)
    assert item[0] == "a b long plain" and item[1]["italic"] == pytest.approx(3 / 14) and item[1]["indent_change"] == pytest.approx(36 / 612) and item[1]["single_letter_words"] == 0.5
    assert [(t, g["in_table"], g["in_box"]) for t, g in rest] == [("x", 0, 0), ("one", 1, 1), ("deep", 1, 1), ("anchor", 0, 0), ("in box", 0, 1)]
