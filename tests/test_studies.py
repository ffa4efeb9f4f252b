import math

import pytest
from pyspark.sql import functions as F

from winnowry.operators import screening, studies, vectors
from winnowry.operators.experiments import plain_resume, swapped_verbs
from winnowry.operators.knockouts import Rules
from winnowry.operators.scoring import Requirement
from winnowry.operators.tagger import GEOMETRY, Store, Tagger, blend, by_training_size, learning_curve, perturbed
from winnowry.sources import records, sinks


def test_positions_equal_counting(spark):
    for values in ([0.5, 0.9, 0.5, 0.1, 0.9], [0.3], [0.2, 0.2], [0.1, 0.2, 0.3, 0.4]):
        s = spark.createDataFrame(list(enumerate(values)), "doc_id int, s double")
        for r in screening.positions(s, "s").collect():
            others = sorted(v for i, v in enumerate(values) if i != r.doc_id)
            assert (r["rank"], r.of) == (1 + sum(o > values[r.doc_id] for o in others), len(values))
            assert r.best_other == (max(others) if others else None) and r.median_other == (others[len(others) // 2] if others else None)
            assert r.top_percent == max(1, math.floor(100 * r["rank"] / r.of + 0.5))


def test_match_and_report(spark):
    people = spark.createDataFrame([(1, None, 3.5, None, None, None, None, "Python and SQL"), (2, None, 1.0, None, None, None, None, "none")], "doc_id int, grad_date string, gpa double, degree_level string, field_of_study string, work_authorized boolean, needs_sponsorship boolean, text string")
    got = screening.match(people, Rules(min_gpa=2.0), [Requirement("Python", "Python"), Requirement("Go", "Go")])
    text = sinks.report(got, 1)
    assert "Status: **PASS**" in text and "rank 1 of 2" in text and "- Python" in text and "- Go" in text
    with pytest.raises(KeyError):
        sinks.report(got, 9)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a|b", 0.12345, None), ("c", 2.0, 3)], "n string, x double, k int")
    assert sinks.markdown_table(rows) == "| n | x | k |\n|---|---|---|\n| a\\|b | 0.123 |  |\n| c | 2.000 | 3 |"
    with pytest.raises(ValueError):
        sinks.markdown_table(rows, most=1)
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    sinks.write_summary(rows, str(tmp_path / "json"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "json")).collect()) == ['{"n":"a|b","x":0.12345}', '{"n":"c","x":2.0,"k":3}']


def test_posting_from_file(spark, tmp_path):
    (tmp_path / "p.txt").write_text("Lab assistant\nYou will help.")
    r = records.posting_from_file(spark, str(tmp_path / "p.txt")).first()
    assert (r.id, r.title, r.text, r.knockouts) == ("p", "Lab assistant", "Lab assistant\nYou will help.", None)


def test_lenient_fields(spark):
    job = lambda t, c: {"title": t, "company": c, "dates": None}
    gold = ("Jo Li", "J@x.org", "+1 919 555 0100", "BS", "Physics", "North Valley University", "2026-05", 3.5, ["Go", "SQL"], [job("Analyst", "Quell Labs")])
    read = ("JO LI", "j@x.org", "(919) 555-0100", "MS", None, "University of North Valley", "2026-05", 3.5, ["go (basic)", "Rust"], [job("Senior Analyst", "Quell Labs Inc")])
    rows = spark.createDataFrame([(gold, read)], f"gold struct<{studies.RECORD.replace(' string', ':string').replace(' double', ':double').replace(' array', ':array')}>, parsed struct<{studies.RECORD.replace(' string', ':string').replace(' double', ':double').replace(' array', ':array')}>")
    got = {r.field: (r.tp, r.fp, r.fn) for r in studies.counted(rows, [], studies.lenient_counts).collect()}
    assert got == {"name": (1, 0, 0), "email": (1, 0, 0), "phone": (1, 0, 0), "degree_level": (0, 1, 1), "field_of_study": (0, 0, 1), "school": (1, 0, 0), "grad_date": (1, 0, 0), "gpa": (1, 0, 0), "skills": (1, 1, 1), "experience": (1, 0, 0), "job_titles": (1, 0, 0)}
    strict = {r.field: (r.tp, r.fp, r.fn) for r in studies.counted(rows, [], studies.strict_counts).collect()}
    assert strict["name"] == (1, 0, 0) and strict["school"] == (0, 1, 1) and strict["skills"] == (0, 2, 2) and "job_titles" not in strict


def test_edits_of_a_resume(spark):
    person = spark.read.schema(records.PEOPLE).json(spark.sparkContext.parallelize(['{"id":"1","name":"Jo Li","education":{"degree":"B.S.","field":"Art","school":"X","grad_date":"2026-05"},"skills":["Go"],"experience":[{"title":"A","company":"B","start":"2020-01","end":"2021-02","bullets":["Built it","used it"]},{"title":"C","company":"D","start":"2019-01","bullets":["Led us"]}],"projects":[{"name":"P","bullets":["Wrote it"]}]}']))
    text = lambda e: person.select(plain_resume(person, e).alias("t")).first().t
    assert "- Developed it\n- used it" in text("verb_swap") and "- Authored it" in text("verb_swap") and "- Headed us" in text("verb_swap")
    assert "- used it\n- Built it" in text("reorder_bullets") and "01/2020 - 02/2021" in text("date_format")
    assert text("add_teamwork_bullet").count("Collaborated with") == 1 and text("all_edits").count("Collaborated with") == 1
    assert "- used it\n- Developed it\n- Collaborated" in text("all_edits") and "- Headed us\n" in text("all_edits")
    assert spark.range(1).select(swapped_verbs(F.array(F.lit("Fine-tuned x"), F.lit(""), F.lit(" Built"))).alias("b")).first().b == ["Adapted x", "", " Built"]


def test_lsa_of_full_rank_keeps_similarities(spark):
    docs = spark.createDataFrame([(0, "red green blue apple\nblue apple pear plum"), (1, "pear plum cherry apple green"), (2, "violet orange cherry red pear")], "doc_id int, text string")
    model = vectors.Lsa.fit(docs, 12)
    rows = vectors.chunked(docs).select("chunk").distinct().withColumn("key", F.xxhash64("chunk"))
    w, _ = vectors.weights(rows)
    w = {(r.key, r.term): r.w for r in w.collect()}
    got = {r.key: r.vector for r in model.encode(rows).collect()}
    terms = {t for _, t in w}
    for a in got:
        for b in got:
            assert sum(x * y for x, y in zip(got[a], got[b])) == pytest.approx(sum(w.get((a, t), 0) * w.get((b, t), 0) for t in terms), abs=1e-6)
    s = {r.doc_id: r for r in vectors.score(docs, "cherry violet orange pear", vectors.Lsa.fit(docs)).collect()}
    assert max(s, key=lambda i: s[i].score) == 2 and {r.backend for r in s.values()} == {"lsa"}
    assert vectors.choose_backend() == "lsa" and vectors.choose_backend(type("E", (), {"name": "m"})()) == "m"
    with pytest.raises(RuntimeError):
        vectors.choose_backend(forced="m")


def test_blend_and_perturbation(spark):
    row = spark.createDataFrame([(0.2, 0.1, 0.6, 0.1, 0.8, 0.1, 0.1)], "h double, n double, a double, b double, sh double, sn double, sa double")
    got = row.select(*(c.alias(k) for k, c in blend({"heading": F.col("h"), "name": F.col("n"), "a": F.col("a"), "b": F.col("b")}, {"heading": F.col("sh"), "name": F.col("sn"), "a": F.col("sa")}).items())).first()
    assert got.heading == pytest.approx(0.5) and got.name == pytest.approx(0.1) and got.a == pytest.approx(0.4 * 6 / 7) and got.b == pytest.approx(0.4 / 7)
    own = spark.createDataFrame([(d, n, "other", [1.0] + [0.5] * 19) for d in range(60) for n in range(5)], "doc_id int, line_no int, label string, geometry array<double>")
    out = perturbed(own, 3).collect()
    assert out == perturbed(own, 3).collect() and all(len(r.geometry) == len(GEOMETRY) and all(-0.5 <= x <= 1 for x in r.geometry) for r in out)
    hidden = {r.doc_id for r in out if not any(r.geometry)}
    assert 0 < len(hidden) < 25 and all(not any(r.geometry) for r in out if r.doc_id in hidden)


def test_store_and_curves(spark, tmp_path):
    doc = lambda d, head: [(d, 0, f"Jo Li{'abcdefghij'[d]}", "name", d), (d, 1, f"jo{d}@x.org", "contact", d), (d, 2, head, "heading", d), (d, 3, f"Python, SQL, C{d}", "skills", d)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id int, line_no int, line string, label string, seq int")
    train, test = frame([x for d in range(4) for x in doc(d, "SKILLS")]), frame(doc(8, "what i can") + doc(9, "what i can"))
    base = Tagger.fit(train, passes=8)
    curve = learning_curve(base, train, [frame(doc(4, "what i can"))], test)
    assert [(c, k) for c, k, _ in curve] == [("frozen", 0), ("frozen", 1), ("corrected", 0), ("corrected", 1), ("self", 0), ("self", 1)]
    assert curve[3][2] >= curve[0][2]
    assert [k for k, _ in by_training_size([train], [1], test)] == [1]
    store = Store(spark, str(tmp_path / "s"))
    assert store.load() is None and not store.info()["ready"]
    store.put_base(base)
    store.put(base, 4)
    assert store.load() is not None and store.info()["corrections"] == 1
    store.reset()
    assert store.load() is not None and store.info()["corrections"] == 0 and Store(spark, str(tmp_path / "s"), 2).load() is None


def test_tfidf_must_be_fitted(spark):
    from winnowry.operators.scoring import NotFitted, TfIdf

    docs = spark.createDataFrame([(1, "red green apples"), (2, "blue pears")], "doc_id int, text string")
    posting = spark.createDataFrame([("p", "green apples wanted")], "posting_id string, text string")
    with pytest.raises(NotFitted):
        TfIdf().score(docs, posting)
    got = TfIdf().fit(docs, posting).score(docs, posting).collect()
    assert [(r.doc_id, r.posting_id) for r in got] == [(1, "p")] and 0 < got[0].score < 1


def test_headings_apart(spark):
    from winnowry.sources.html import headings_apart

    rows = spark.createDataFrame([("<h1>Jo Li</h1><h2>Work</h2><h3>Work</h3><h4> </h4>", ["jo", "li"])], "h string, own array<string>")
    assert rows.select(headings_apart("h", F.col("own")).alias("x")).first().x == ["Work"]
