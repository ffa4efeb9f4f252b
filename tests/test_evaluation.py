import random

import pytest
from pyspark.sql import functions as F

from winnowry.operators import bootstrap, experiments, layout, lines, metrics
from winnowry.operators.alignment import compare_readings, concatenation_of, find_near, labels_by_position, match_lines, merge_wrapped, reading_risks
from winnowry.operators.diagnose import level, mask, risks


def test_counts(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "b"), ("a", None), (None, None)], "g string, p string")
    assert [tuple(r.c) for r in rows.select(metrics.scalar_counts(F.col("g"), F.col("p")).alias("c")).collect()] == [(1, 0, 0), (0, 1, 1), (0, 1, 0), (0, 0, 1), (0, 0, 0)]
    assert tuple(spark.range(1).select(metrics.set_counts(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"), F.lit("c"))).alias("c")).first().c) == (1, 1, 1)
    zero = metrics.micro(spark.createDataFrame([(0, 0, 0)], "tp long, fp long, fn long")).first()
    assert (zero.precision, zero.recall, zero.f1) == (0, 0, 0)


def plain_greedy(gold, pred, close):
    rest, tp = list(pred), 0
    for g in gold:
        i = next((i for i, p in enumerate(rest) if close(g, p)), None)
        if i is not None:
            tp += 1
            del rest[i]
    return tp, len(rest), len(gold) - tp


def plain_close(g, p):
    g, p = g.split(), p.split()
    return bool(g) and bool(p) and set(g) <= set(p) and len(p) - len(g) <= 3


def test_greedy_matches_plain(spark):
    r = random.Random(0)
    word = lambda: " ".join(r.choice("abc") for _ in range(r.randint(0, 3)))
    rows = [(i, [word() for _ in range(r.randint(0, 4))], [word() for _ in range(r.randint(0, 5))]) for i in range(60)]
    got = spark.createDataFrame(rows, "i int, g array<string>, p array<string>").select("i", metrics.greedy_counts(F.col("g"), F.col("p")).alias("c")).collect()
    assert {x.i: tuple(x.c) for x in got} == {i: plain_greedy(g, p, plain_close) for i, g, p in rows}


def test_votes(spark):
    rows = [(1, 0, "A"), (1, 1, "B"), (1, 2, "b"), (2, 0, "x"), (2, 1, "y"), (3, 0, None)]
    got = metrics.vote(spark.createDataFrame(rows, "d int, engine_rank int, value string").withColumn("key", F.lower("value")), "d").collect()
    assert {r.d: (r.value, r.votes) for r in got} == {1: ("B", 2), 2: ("x", 1)}
    lists = [[], ["quell labs", "go"], ["Quell Labs US", "rust"], ["rust", "go", "zig"]]
    arr = F.array(*(F.array(*map(F.lit, x)) if x else F.array().cast("array<string>") for x in lists))
    assert spark.range(1).select(metrics.vote_list(arr).alias("v")).first().v == ["quell labs", "go", "rust"]


def test_bootstrap_contains_and_degenerates(spark):
    rows = spark.createDataFrame([(i, "x", float(i)) for i in range(1, 6)] + [(i, "y", 2.0) for i in range(1, 4)], "case int, g string, v double")
    got = {r.g: r for r in bootstrap.mean_bounds(rows, "case", "v", ["g"], 300).collect()}
    assert got["x"].lo < 3 < got["x"].hi and got["y"].lo == got["y"].hi == 2
    assert bootstrap.draws(rows, "case", 50).groupBy("boot").agg(F.sum("times").alias("n")).where("n <> 5").count() == 0


def test_rank_changes_equal_counting(spark):
    r = random.Random(1)
    pool = [(i, r.randrange(12) / 10) for i in range(60)]
    variants = [(i, s, r.randrange(14) / 10) for i, s in pool[:25]]
    got = experiments.rank_changes(spark.createDataFrame(pool, "doc_id int, before double"), spark.createDataFrame(variants, "doc_id int, before double, after double")).collect()
    rank = lambda i, s: 1 + sum(o > s + 1e-12 for j, o in pool if j != i)
    assert {x.doc_id: (x.rank_before, x.rank_after) for x in got} == {i: (rank(i, b), rank(i, a)) for i, b, a in variants}


def test_attacks():
    assert experiments.stuffing("a\n b", ["x", "y"], "keyword_list") == "x, y x, y x, y"
    assert experiments.stuffing("a\n b", [], "hidden_posting") == "a b"
    with pytest.raises(ValueError):
        experiments.stuffing("", [], "other")


def test_best_match_takes_the_first_of_equals(spark):
    rows = spark.createDataFrame([(1, 0, "alpha beta"), (1, 1, "gamma"), (1, 2, "zeta eta theta")], "doc_id int, line_no int, line string")
    ref = spark.createDataFrame([(1, 0, "name", ["alpha", "beta", "x"]), (1, 1, "skills", ["alpha", "beta"]), (1, 2, "other", ["beta", "alpha"]), (1, 3, "late", ["zeta"])], "doc_id int, ord int, label string, tokens array<string>")
    assert {r.line_no: r.label for r in lines.best_match(rows, ref).collect()} == {0: "skills"}


def test_rows_and_visible(spark):
    words = [(10.0, 1.0), (11.9, 2.0), (12.1, 3.0), (30.0, 1.0)]
    df = spark.createDataFrame([(words,)], "w array<struct<top:double,x0:double>>")
    assert [len(x) for x in df.select(layout.rows_of("w").alias("r")).first().r] == [2, 1, 1]
    chars = [("a", 10.0, [0.0]), ("b", 3.0, [0.0]), ("c", 9.0, [1.0]), ("d", 9.0, [1.0, 1.0, 0.99]), ("e", 9.0, [0.0, 0.0, 0.0, 0.0]), ("f", None, [])]
    df = spark.createDataFrame([(chars,)], "c array<struct<c:string,size:double,color:array<double>>>")
    assert "".join(x.c for x in df.select(layout.visible_chars("c").alias("v")).first().v) == "af"


def test_boxes(spark):
    rect = spark.createDataFrame([(1, 0, 600.0, 0.0, 0.0, 100.0, 50.0), (1, 0, 600.0, 0.0, 0.0, 30.0, 50.0), (1, 0, 600.0, 0.0, 0.0, 590.0, 50.0), (1, 0, 600.0, 200.0, 200.0, 300.0, 250.0)], "doc_id int, page int, width double, x0 double, top double, x1 double, bottom double")
    tables = spark.createDataFrame([(1, 0, 190.0, 190.0, 400.0, 400.0)], "doc_id int, page int, x0 double, top double, x1 double, bottom double")
    found = layout.boxes(rect, tables)
    assert [(r.x0, r.x1) for r in found.collect()] == [(0.0, 100.0)]
    words = spark.createDataFrame([(1, 0, 10.0, 10.0, 20.0, 20.0), (1, 0, 110.0, 10.0, 120.0, 20.0)], "doc_id int, page int, x0 double, top double, x1 double, bottom double")
    assert layout.in_box(words, found).count() == 1 and layout.in_box(words, found, "left_anti").first().x0 == 110.0


def test_masking(spark):
    rows = [("Jo Li", "name"), ("mail jo.li@x.org or +1 919-555-0100, github.com/joli", "contact"), ("A paper by LI and others", "other")]
    got = spark.createDataFrame(rows, "line string, label string").select(mask("line", F.col("label"), F.array(F.lit("Jo"), F.lit("Li"))).alias("m")).collect()
    assert [(r.m.line, r.m.masked) for r in got] == [("[name]", 1), ("mail [email] or [phone], [link]", 3), ("A paper by [name] and others", 1)]


def test_risks(spark):
    text = "AAbbcc ddEE ffgg hhii jjkk llmm " * 3
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(risks("t").alias("r")).select("r", level(F.col("r")).alias("l")).collect()
    assert [g.l for g in got] == ["bad", "bad", "bad"] and "doubled letters" in [x.kind for x in got[0].r] and [x.kind for x in got[1].r] == ["no text"]


def test_alignments():
    assert labels_by_position(["Work", "did things", "nowhere at all", "Python"], [("WORK", "heading"), ("did  things", "experience"), ("Skills", "heading"), ("Python", "skills")]) == ["heading", "experience", None, "skills"]
    assert match_lines(["b c", "a b c d"], ["a", "b", "c", "d", "b", "c"]) in ([[4, 5], [0, 1, 2, 3]], [[1, 2], [0]])
    assert concatenation_of("EducationExperience", {"education", "experience"}) and not concatenation_of("Education", {"education"})
    page = "Jordan Avery worked on several machines in the laboratory and wrote reports about them"
    kinds = lambda a, b: [k for _, k in reading_risks(compare_readings(a, b))]
    assert kinds(page, page) == ["readings agree"] and kinds("", page) == ["image only"] and kinds(page, "") == ["readings agree"]
    assert kinds(page.replace("several machines", "severalmachines"), page) == ["words run together"]
    assert kinds(page, page + " certificate of completion") == ["text missing"] and kinds(page, page + " odd") == ["readings agree"]
    assert compare_readings(page, page + " certificate of completion")["missing"] == ["certificate of completion"] or compare_readings(page, page + " certificate of completion")["missing"] == ["certificate completion"]
    assert find_near("x" * 500 + "abcd", "abcd", 0) == (500, 504) and find_near("x" * 4000 + "abcd", "abcd", 0) == (-1, -1)
    long = "abcdefghijklmnopqrstuvwxyz"
    assert find_near("--" + long[:16] + "--", long, 0) == (2, 18) and find_near("--" + long[:16], long[:20], 0) == (-1, -1)
    assert merge_wrapped([("a long exam-", 10, 198, 10), ("ple of it.", 10, 60, 10), ("- item", 10, 198, 10)], 200) == [("a long example of it.", [0, 1]), ("- item", [2])]


def test_queries_take_whole_texts(spark, tmp_path):
    """Words and lines behind the first 400 characters, 11 words and 6 lines count."""
    from winnowry.plans import metrics as plans

    r = random.Random(2)
    vocabulary = ["".join(r.choice("abcdeFG") for _ in range(r.randint(4, 7))) for _ in range(40)]
    texts = ["\n".join(" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 4))) for _ in range(r.choice([1, 3, 60]))) for _ in range(40)]
    texts[5:8] = ["", "a bc", "word"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: (x.tp, x.fp, x.fn) for x in plans.skill_set_counts(spark, str(tmp_path)).collect()}
    sets = [set(t.split(" ")) for t in texts]
    assert got == {i: (len(sets[i] & sets[i - 1]), len(sets[i - 1] - sets[i]), len(sets[i] - sets[i - 1])) for i in range(1, 40)}
    got = {x.doc_id: (x.tp, x.fp, x.fn) for x in plans.lenient_counts(spark, str(tmp_path)).collect()}
    assert got == {i: plain_greedy(texts[i].split("\n"), texts[i - 1].split("\n"), lambda g, p: plain_close(g.lower(), p.lower())) for i in range(1, 40)}
    got = {x.doc_id: x["items"] for x in plans.vote_list(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        w = [x for x in t.split() if len(x) > 3]
        cut = lambda a, b: w[(k := len(w) * a // 11) : k - (-len(w) * (b - a) // 11)]
        first, *rest = cut(0, 6), cut(3, 9), cut(7, 11)
        assert not w or cut(7, 11) == [] or cut(7, 11)[-1] == w[-1]
        out, low = list(first), lambda x: {y.lower() for y in x}
        for x in [y for z in rest for y in z]:
            if x.lower() not in low(out) and sum(x.lower() in low(z) for z in (first, *rest)) >= 2:
                out.append(x)
        assert got[i] == " ".join(out)


def test_pools_leave_no_row_out(spark):
    from winnowry.plans import metrics as plans

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labelled = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = plans.union_pool(spark, sf).collect()
    assert sorted((r.doc_id, r.origin, r.n_chars) for r in got) == sorted((r.doc_id, "second" if r.doc_id in labelled else "first", r.n_chars) for r in docs.collect())
    whole = bootstrap.mean_bounds(docs.withColumn("v", F.col("n_chars").cast("double")), "source", "v", ["lang"], plans.N_BOOT)
    assert {(r.lang, round(r.lo, 6), round(r.hi, 6)) for r in whole.collect()} == {(r.lang, r.lo, r.hi) for r in plans.bootstrap_mean(spark, sf).collect()}
