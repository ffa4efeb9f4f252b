"""Studies, matches and round trips through files over people made of customer rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields
from ..operators import bootstrap as B
from ..operators import metrics as M
from ..operators import sampling
from ..operators import studies as S
from ..operators.knockouts import Person, outcome
from ..operators.scoring import Keyword, Requirement
from ..operators.screening import in_order, match, screen, screen_postings, warm, warmed
from ..sources import records
from ..streaming import feeds
from . import linework, texts
from .metrics import _CASES, _draws, N_BOOT
from .screening import _SQL_POOL, POSTING, RULES, _sql_outcome, _sql_score, pool
from .tables import dealt, scratch, table
from .texts import _PERSON

#: A layout of a person's text, and which parser finds what in it. In "boxed" headings have words that only the second parser knows.
LAYOUTS = ("single", "boxed", "name_last")
BOXED = {"EDUCATION": "STUDY BOX", "Experience:": "WORK BOX:", "SKILLS": "TOOL BOX"}
AWARE = {**fields.HEADINGS, "education": (*fields.HEADINGS["education"], "study box"), "experience": (*fields.HEADINGS["experience"], "work box"), "skills": (*fields.HEADINGS["skills"], "tool box")}
POSTINGS = [Requirement("Python", "Python"), Requirement("SQL", "SQL", "preferred"), Requirement("Biology", "Biology", "preferred"), Requirement("Study box", "Study box", "preferred", curated=False)]
ATTEMPTED = {"naive": ("name", "email", "phone", "degree_level", "school", "skills"), "layout_aware": None}
COMMON = ATTEMPTED["naive"]


def _people(spark, sf_dir) -> DataFrame:
    return spark.sql(_PERSON, customer=table(spark, sf_dir, "customer"))


def _texts(spark, sf_dir) -> DataFrame:
    """(doc_id, case, gold, layout, text): each person in each layout."""
    people = dealt(_people(spark, sf_dir), "doc_id")
    contact = F.concat_ws(" | ", "email", "phone")
    study = F.concat(F.lit("EDUCATION\n"), "degree", F.lit(" in "), "field_of_study", F.lit("\n"), "school", F.lit("\n"), F.date_format(F.to_date(F.concat("grad_date", F.lit("-01"))), "MMM yyyy"), F.when(F.col("gpa").isNotNull(), F.format_string("\nGPA: %.2f", "gpa")).otherwise(""))
    rest = F.concat(study, F.lit("\n\nExperience:\nAnalyst | Quell Labs | Jun 2019 - 08/2020\n- found things\n\nSKILLS\nLanguages: Python, SQL; "), "skill")
    # What the layouts share is written once a person, as columns: within a generator nothing is shared or compiled.
    people = people.withColumns({"contact": contact, "rest": rest})
    single = F.concat("name", F.lit("\n"), "contact", F.lit("\n\n"), "rest")
    boxed = F.col("single")
    for a, b in BOXED.items():
        boxed = F.replace(boxed, F.lit(a), F.lit(b))
    last = F.concat("contact", F.lit("\n\n"), "rest", F.lit("\n"), "name")
    job = F.array(F.struct(F.lit("Analyst").alias("title"), F.lit("Quell Labs").alias("company"), F.lit("Jun 2019 - 08/2020").alias("dates")))
    gold = F.struct("name", "email", "phone", "degree_level", "field_of_study", "school", "grad_date", "gpa", F.array(F.lit("Python"), F.lit("SQL"), F.col("skill")).alias("skills"), job.alias("experience"))
    people = people.withColumn("single", single).select("doc_id", (F.col("doc_id") % 25).alias("case"), gold.alias("gold"), "single", boxed.alias("boxed"), last.alias("name_last"))
    each = F.array(*(F.struct(F.lit(n).alias("layout"), F.col(n).alias("text")) for n in LAYOUTS))
    return people.select("doc_id", "case", "gold", F.inline(each))


def _parsed(spark, sf_dir) -> DataFrame:
    """(doc_id, case, layout, parser, gold, parsed, text) by two parsers."""
    texts, out = _texts(spark, sf_dir), None
    for parser, headings in (("naive", fields.HEADINGS), ("layout_aware", AWARE)):
        got = fields.parse(texts, "text", fields.sections("text", headings))
        got = got.select("doc_id", "case", "layout", F.lit(parser).alias("parser"), "gold", F.struct(*S.STRICT).alias("parsed"), "text")
        out = got if out is None else out.unionAll(got)
    return out


CELL = ["parser", "layout"]


def layout_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict counts of every person, parser, layout and field."""
    return S.counted(_parsed(spark, sf_dir), ["doc_id", *CELL])


def layout_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.layout_summary(S.counted(_parsed(spark, sf_dir), ["case", *CELL]), "case", CELL, N_BOOT)
    return got.select(*CELL, "tp", "fp", "fn", *(F.round(c, 5).alias(c) for c in ("precision", "recall", "f1", "f1_drop_pct", "f1_lo", "f1_hi")))


def layout_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.per_field(S.counted(_parsed(spark, sf_dir), CELL), ["parser"], "layout", list(LAYOUTS))
    return got.select("parser", "field", *(F.round(c, 6).alias(c) for c in LAYOUTS))


def _downstream(spark, sf_dir) -> DataFrame:
    own = _parsed(spark, sf_dir)
    extra = own.select("doc_id", *CELL, "parsed.*", "text").withColumns({"work_authorized": F.col("doc_id") % 3 != 0, "needs_sponsorship": F.col("doc_id") % 7 == 0})
    status = lambda policy: outcome(Person.of_columns(), RULES, policy)["status"]
    rows = extra.select("doc_id", *CELL, status("review").alias("review"), status("reject").alias("reject"), F.round(Keyword().score("text", POSTINGS), 4).alias("keyword"))
    return S.downstream(rows, ["doc_id", "parser"])


def layout_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.effects(_downstream(spark, sf_dir), CELL).withColumn("mean_keyword_change", F.round("mean_keyword_change", 6))


def layout_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.transitions(_downstream(spark, sf_dir), "review_single", "review", *CELL)


def _lenient(spark, sf_dir) -> DataFrame:
    return S.attempted_only(S.counted(_parsed(spark, sf_dir), ["doc_id", "case", *CELL], S.lenient_counts), ATTEMPTED)


def lenient_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lenient counts of the fields that each parser attempts."""
    return _lenient(spark, sf_dir).groupBy(*CELL, "field").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


def parser_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.parser_benchmark(_lenient(spark, sf_dir), "case", CELL, COMMON, N_BOOT)
    return got.select(*CELL, "tp", "fp", "fn", *(F.round(c, 5).alias(c) for c in ("f1", "f1_lo", "f1_hi")))


def parser_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.parser_accuracy(_lenient(spark, sf_dir), ["doc_id", *CELL]).select("doc_id", *CELL, F.round("f1", 6).alias("f1"))


def voted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vote of both parsers on the boxed layout, and the reading that is preferred of all three."""
    own = _parsed(spark, sf_dir).where("layout = 'boxed'").select("doc_id", "parser", "parsed")
    got = S.preferred(own.unionByName(S.voted(own, ["naive", "layout_aware"])))
    return got.select("doc_id", "parser", "parsed.name", "parsed.school", "parsed.gpa", "parsed.grad_date", F.array_join("parsed.skills", "; ").alias("skills"))


def match_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate against the posting: status, place in the pool, terms."""
    got = match(pool(spark, sf_dir), RULES, POSTING)
    return got.select("doc_id", "status", "score", "rank", "of", "best_other", "median_other", "top_percent", F.array_join("terms_found", "; ").alias("found"), F.array_join("terms_missing", "; ").alias("lacking"))


def screen_two_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = screen_postings(pool(spark, sf_dir), {"a": (RULES, POSTING), "b": (RULES, POSTING[:3])})
    return got.select("posting_id", "doc_id", "status", "score_keyword", F.col("rank_keyword").cast("long").alias("rank_keyword"))


def screening_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 of the screened pool in their order."""
    return in_order(screen(pool(spark, sf_dir), RULES, POSTING)).select("doc_id", "status", "score_keyword").limit(20)


def skill_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("s"))
    got = S.skill_groups(F.col("s"), {"1-URGENT": "fast", "2-HIGH": "fast", "5-LOW": "slow"}, {"fast": "Soon", "slow": "Later"})
    return rows.select("o_custkey", F.posexplode(got).alias("n", "g")).select("o_custkey", "n", "g.label", F.array_join("g.skills", ", ").alias("skills"))


def complete_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risks of reading, status and place of every candidate in one row."""
    got = S.analyze(pool(spark, sf_dir), RULES, POSTING)
    return got.select("doc_id", "level", F.array_join("risks", "; ").alias("kinds"), "read_by", "parsed.email", "status", "score", "rank", "of")


def pool_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of the pool for two postings, written once and read for one of them."""
    path = scratch(spark)
    warm(table(spark, sf_dir, "documents"), {"a": POSTING, "b": POSTING[:3]}, path)
    return warmed(spark, path, "b").select("score", "n")


def people_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People written as JSON and read again, and their exchange records."""
    p, path = _people(spark, sf_dir), scratch(spark)
    study = F.struct("degree", "degree_level", F.col("field_of_study").alias("field"), "school", F.lit("Here").alias("location"), "grad_date", F.coalesce("gpa", F.lit(1.5)).alias("gpa"))
    job = F.struct(F.lit("Analyst").alias("title"), F.lit("Quell Labs").alias("company"), F.lit("There").alias("location"), F.lit("2019-06").alias("start"), F.lit("2020-08").alias("end"), F.array(F.lit("found things")).alias("bullets"))
    own = p.select(F.col("doc_id").cast("string").alias("id"), F.lit("x").alias("intent"), "name", "email", F.coalesce("phone", F.lit("0")).alias("phone"), F.lit("Town, ST").alias("location"), study.alias("education"), F.array("skill").alias("skills"), F.array(job).alias("experience"), F.array(F.struct(F.lit("P").alias("name"), F.array(F.lit("made it")).alias("bullets"))).alias("projects"))
    own.write.option("multiLine", False).json(path)
    got = spark.read.schema(records.PEOPLE).json(path)
    return got.select("id", S.interchange(got).alias("record"))


def postings_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings written one a file and read again with their rules."""
    path = scratch(spark)
    own = table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.col("n_name").alias("title"), F.concat(F.lit("Work in "), "n_name").alias("text"), F.struct(F.array(F.lit("2025-01"), F.lit("2026-01")).alias("grad_window"), (F.col("n_regionkey") / 2 + 1).alias("min_gpa")).alias("knockouts"))
    own.repartition(25, "id").write.json(path)
    got = spark.read.schema(records.POSTINGS).json(path)
    return got.select("id", "title", "text", F.col("knockouts.grad_window")[0].alias("low"), "knockouts.min_gpa", "knockouts.no_sponsorship")


def resumes_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as CSV with quotes and line feeds, and read again by category."""
    path = scratch(spark)
    table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ID"), F.col("text").alias("Resume_str"), F.col("source").alias("Category")).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    got = records.resumes_csv(spark, path, ["SRC0", "src3", "Src5"])
    return got.select("id", F.md5("text").alias("digest"), "category")


def labels_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line labels exported and read again; geometry of another width is gone."""
    path = scratch(spark)
    own = table(spark, sf_dir, "customer").select(F.lit("1").alias("version"), F.array("c_name").alias("lines"), F.array("c_mktsegment").alias("labels"), F.when(F.col("c_custkey") % 3 == 0, F.array(F.array(F.lit(1.0), F.lit(2.0)))).otherwise(F.array(F.array(F.lit(1.0)))).alias("geometry"))
    records.export_labels(own, path)
    return records.exported_labels(spark, path, 2).select(F.col("lines")[0].alias("line"), F.col("labels")[0].alias("label"), F.size("geometry").cast("long").alias("rows"))


def vector_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that a cache of another run lacks: vectors of the other backend don't count."""
    path = scratch(spark)
    own = table(spark, sf_dir, "customer").select(F.col("c_name").alias("chunk"), F.array(F.lit(1.0)).alias("vector"), "c_mktsegment")
    records.write_vectors(own.where("c_mktsegment < 'F'"), path, "first")
    records.write_vectors(own.where("c_mktsegment >= 'F'"), path, "other")
    return records.not_cached(own, records.vector_cache(spark, path, "first")).select("chunk")


def arrivals_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream against the scores of the pool they come from."""
    docs = table(spark, sf_dir, "documents")
    people = docs.select("doc_id", "text", F.lit(None).cast("string").alias("grad_date"), (F.col("n_chars") % 400 / 100).alias("gpa"), *(F.lit(None).cast(t).alias(n) for n, t in (("degree_level", "string"), ("field_of_study", "string"), ("work_authorized", "boolean"), ("needs_sponsorship", "boolean"))))
    source, sink = scratch(spark), scratch(spark)
    people.write.parquet(source)
    steps = feeds.pool_steps(docs.select(F.round(Keyword().score("text", POSTING), 4).alias("score")))
    out = feeds.score_arrivals(spark.readStream.schema(people.schema).parquet(source), RULES, POSTING, steps)
    out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{sink}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(sink).select("doc_id", "status", "score", "better")


def replay_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive in micro-batches; each leaves the newest 100 of its own and the memory before."""
    source, memory = scratch(spark), scratch(spark)
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    events.repartition(4).write.parquet(source)

    def update(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(f"{memory}/{number - 1}") if number else batch.limit(0)
        sampling.newest(before.unionByName(batch), "event_id", 100).write.mode("overwrite").parquet(f"{memory}/{number}")

    q = feeds.learn_from(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source), update, f"{memory}-state")
    q.awaitTermination()
    return spark.read.parquet(f"{memory}/{q.lastProgress['batchId']}")


QUERIES = {
    f.__name__: f
    for f in (layout_counts, layout_overall, layout_fields, layout_effects, layout_transitions, lenient_fields, parser_benchmark, parser_accuracy, voted_fields, match_positions, screen_two_postings, screening_order, complete_analysis, pool_cache, skill_groups, people_file, postings_file, resumes_file, labels_file, vector_cache, arrivals_scored, replay_memory)
}

_P = "(" + _PERSON.format(customer="customer").replace("string", "VARCHAR").replace("0D", "0::DOUBLE").replace("array(", "list_value(").replace("element_at", "list_extract") + ")"
_CELLS = "(SELECT * FROM (VALUES ('naive'), ('layout_aware')) a(parser), (VALUES ('single'), ('boxed'), ('name_last')) b(layout))"
# What a parser reads is the record, but for what the layout hides from it.
_LOST = "(parser = 'naive' AND layout = 'boxed')"
_SEEN = f"""seen AS (SELECT p.doc_id, p.doc_id % 25 AS "case", parser, layout, p.name AS g_name, CASE WHEN layout <> 'name_last' THEN p.name END AS name, p.email, p.phone, p.skill, {_LOST} AS lost, layout = 'name_last' AS last, p.gpa, p.phone IS NOT NULL AS has_phone, p.gpa IS NOT NULL AS has_gpa,
 CASE WHEN NOT {_LOST} THEN p.degree_level END AS degree_level, CASE WHEN NOT {_LOST} THEN p.field_of_study END AS field_of_study, CASE WHEN NOT {_LOST} THEN p.school END AS school, CASE WHEN NOT {_LOST} THEN p.grad_date END AS grad_date FROM {_P} p, {_CELLS})"""


def _counts_sql(names: tuple[str, ...]) -> str:
    """Rows of counts: a field is right, or missing where it is lost; a name after the skills is read as part of the last one."""
    hit = {"name": ("NOT last", "true"), "email": ("true", "true"), "phone": ("true", "has_phone"), "gpa": ("true", "has_gpa")}
    out = []
    for f in names:
        if f == "skills":
            # Leniently a name of two words more is near enough.
            more = 0 if "job_titles" in names else 1
            tp, fp, fn = f"CASE WHEN lost THEN 0 WHEN last THEN {3 - more} ELSE 3 END", f"CASE WHEN last AND NOT lost THEN {more} ELSE 0 END", f"CASE WHEN lost THEN 3 WHEN last THEN {more} ELSE 0 END"
        else:
            seen, there = hit.get(f, ("NOT lost", "true"))
            tp, fp, fn = f"CASE WHEN {there} AND {seen} THEN 1 ELSE 0 END", "0", f"CASE WHEN {there} AND NOT ({seen}) THEN 1 ELSE 0 END"
        out.append(f"SELECT doc_id, \"case\", parser, layout, '{f}' AS field, ({tp})::BIGINT AS tp, ({fp})::BIGINT AS fp, ({fn})::BIGINT AS fn FROM seen")
    return " UNION ALL ".join(out)


_STRICT = f"WITH {_SEEN}, c AS ({_counts_sql(S.STRICT)})"
_COMMON = ", ".join(f"'{f}'" for f in COMMON)
_LENIENT = f"WITH {_SEEN}, every AS ({_counts_sql(S.LENIENT)}), c AS (SELECT * FROM every WHERE parser = 'layout_aware' OR field IN ({_COMMON}))"
_SUM = "sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn"
_F1 = "CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END"


def _bounds(cells: str) -> str:
    return f"""w AS (SELECT boot, c AS "case", times FROM {_draws(_CASES.format('"case"', "c"))}), b AS (SELECT {cells}, boot, sum(tp * times) AS tp, sum(fp * times) AS fp, sum(fn * times) AS fn FROM c JOIN w USING ("case") GROUP BY ALL),
i AS (SELECT {cells}, quantile_cont({_F1}, 0.025) AS f1_lo, quantile_cont({_F1}, 0.975) AS f1_hi FROM b GROUP BY ALL)"""


_RULED = f"p AS (SELECT doc_id, parser, layout, grad_date, gpa, degree_level, field_of_study, doc_id % 3 <> 0 AS work_authorized, doc_id % 7 = 0 AS needs_sponsorship, skill FROM seen)"
_DOWN = f"""WITH {_SEEN}, {_RULED}, {_sql_outcome("review")}, r AS (SELECT doc_id, parser, layout, status AS review FROM q), {_sql_outcome("reject").replace("o AS (", "o2 AS (").replace("q AS (", "q2 AS (").replace("FROM o)", "FROM o2)")},
d AS (SELECT r.*, q2.status AS reject, round((2.0 + 1.0 + CASE WHEN q2.doc_id % 3 = 1 THEN 1.0 ELSE 0 END + CASE WHEN q2.layout = 'boxed' THEN 0.5 ELSE 0 END) / 4.5::DOUBLE, 4) AS keyword FROM r JOIN q2 USING (doc_id, parser, layout)),
e AS (SELECT d.*, s.review AS review_single, s.reject AS reject_single, s.keyword AS keyword_single FROM d JOIN d s ON s.doc_id = d.doc_id AND s.parser = d.parser AND s.layout = 'single')"""
_EXPLAIN = "array_to_string(list_transform(list_filter(e, lambda x: {} x.h), lambda x: x.l), '; ')"


def _match_sql() -> str:
    from ..functions.terms import sql_count
    from ..operators.scoring import units

    rows = ", ".join(f"{{'l': '{' / '.join(r.surface for r in u)}', 'h': {' OR '.join(f'{sql_count("text", r.surface)} > 0' for r in u)}}}" for u in units(POSTING))
    return f"""WITH p AS ({_SQL_POOL}), {_sql_outcome("review")}, s AS (SELECT doc_id, status, {_sql_score(POSTING)} AS score, [{rows}] AS e FROM q)
SELECT doc_id, status, score, 1 + (SELECT count(*) FROM s o WHERE o.score > s.score + 1e-12 AND o.doc_id <> s.doc_id) AS rank, (SELECT count(*) FROM s) AS of, (SELECT max(score) FROM s o WHERE o.doc_id <> s.doc_id) AS best_other,
 (SELECT list_sort(list(score))[count(*) // 2 + 1] FROM s o WHERE o.doc_id <> s.doc_id) AS median_other, greatest(1, round(100 * (1 + (SELECT count(*) FROM s o WHERE o.score > s.score + 1e-12 AND o.doc_id <> s.doc_id)) / (SELECT count(*) FROM s)::DOUBLE))::BIGINT AS top_percent,
 {_EXPLAIN.format("")} AS found, {_EXPLAIN.format("NOT")} AS lacking FROM s"""


RISKS, EMAILS = linework.ORACLES["document_risks"], texts.ORACLES["extract_email"]
_SCREENED = f"WITH p AS ({_SQL_POOL}), {_sql_outcome('review')}"
_RANK = "CASE WHEN status <> 'REJECT' THEN rank() OVER (PARTITION BY posting_id, status <> 'REJECT' ORDER BY score_keyword DESC) END"
ORACLES = {
    "layout_counts": f"{_STRICT} SELECT doc_id, parser, layout, field, tp, fp, fn FROM c",
    "layout_overall": f"""{_STRICT}, {_bounds("parser, layout")}, s AS (SELECT parser, layout, {_SUM} FROM c GROUP BY ALL), p AS (SELECT *, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall, {_F1} AS f1 FROM s)
SELECT a.parser, a.layout, a.tp, a.fp, a.fn, round(a.precision, 5) AS precision, round(a.recall, 5) AS recall, round(a.f1, 5) AS f1, round(100 * (z.f1 - a.f1) / z.f1, 5) AS f1_drop_pct, round(f1_lo, 5) AS f1_lo, round(f1_hi, 5) AS f1_hi
FROM p a JOIN p z ON z.parser = a.parser AND z.layout = 'single' JOIN i ON i.parser = a.parser AND i.layout = a.layout""",
    "layout_fields": f"{_STRICT}, s AS (SELECT parser, layout, field, {_SUM} FROM c GROUP BY ALL) SELECT parser, field, " + ", ".join(f"max(CASE WHEN layout = '{n}' THEN round({_F1}, 6) END) AS {n}" for n in LAYOUTS) + " FROM s GROUP BY ALL",
    "layout_effects": f"""{_DOWN} SELECT parser, layout, count(*) AS pairs, count(*) FILTER (review <> review_single) AS flips_review_policy, count(*) FILTER (reject <> reject_single) AS flips_reject_policy, count(*) FILTER (reject = 'REJECT' AND reject_single <> 'REJECT') AS newly_rejected,
 count(*) FILTER (reject <> 'REJECT' AND reject_single = 'REJECT') AS newly_passed, round(avg(keyword - keyword_single), 6) AS mean_keyword_change FROM e GROUP BY ALL""",
    "layout_transitions": f"{_DOWN} SELECT parser, layout, review_single, review, count(*) AS count FROM e WHERE review <> review_single GROUP BY ALL",
    "lenient_fields": f"{_LENIENT} SELECT parser, layout, field, {_SUM} FROM c GROUP BY ALL",
    "parser_benchmark": f"""WITH {_SEEN}, c AS ({_counts_sql(S.LENIENT)}), {_bounds("parser, layout").replace("FROM c JOIN w", f"FROM (SELECT * FROM c WHERE field IN ({_COMMON})) c JOIN w")}, s AS (SELECT parser, layout, {_SUM} FROM c WHERE field IN ({_COMMON}) GROUP BY ALL)
SELECT parser, layout, tp, fp, fn, round({_F1}, 5) AS f1, round(f1_lo, 5) AS f1_lo, round(f1_hi, 5) AS f1_hi FROM s JOIN i USING (parser, layout)""",
    "parser_accuracy": f"{_LENIENT}, s AS (SELECT doc_id, parser, layout, {_SUM} FROM c GROUP BY ALL) SELECT doc_id, parser, layout, round({_F1}, 6) AS f1 FROM s",
    "voted_fields": f"SELECT doc_id, 'vote' AS parser, name, school, gpa, grad_date, 'Python; SQL; ' || skill AS skills FROM {_P}",
    "match_positions": _match_sql(),
    "screen_two_postings": f"{_SCREENED}, s AS (SELECT 'a' AS posting_id, doc_id, status, {_sql_score(POSTING)} AS score_keyword FROM q UNION ALL SELECT 'b', doc_id, status, {_sql_score(POSTING[:3])} FROM q) SELECT *, {_RANK} AS rank_keyword FROM s",
    "screening_order": f"{_SCREENED}, s AS (SELECT doc_id, status, {_sql_score(POSTING)} AS score_keyword FROM q) SELECT doc_id, status, score_keyword FROM s ORDER BY status = 'REJECT', CASE WHEN status <> 'REJECT' THEN -score_keyword END, doc_id LIMIT 20",
    "complete_analysis": f"SELECT doc_id, level, kinds, 'naive' AS read_by, email, status, score, rank, of FROM ({RISKS}) r JOIN ({_match_sql()}) m USING (doc_id) JOIN ({EMAILS}) e USING (doc_id)",
    "pool_cache": f"SELECT score, count(*) AS n FROM (SELECT {_sql_score(POSTING[:3])} AS score FROM documents) GROUP BY ALL",
    "skill_groups": """WITH a AS (SELECT DISTINCT o_custkey, o_orderpriority AS s, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Soon' WHEN o_orderpriority = '5-LOW' THEN 'Later' ELSE 'Other' END AS label FROM orders),
g AS (SELECT o_custkey, label, min(s) AS first, string_agg(s, ', ' ORDER BY s) AS skills FROM a GROUP BY ALL) SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY first) - 1 AS n, label, skills FROM g""",
    "people_file": f"""SELECT doc_id::VARCHAR AS id, '{{"basics":{{"name":"' || name || '","email":"' || email || '","phone":"' || coalesce(phone, '0') || '","location":{{"city":"Town","region":"ST"}}}},"work":[{{"name":"Quell Labs","position":"Analyst","location":"There","startDate":"2019-06-01","endDate":"2020-08-01","highlights":["found things"]}}],"education":[{{"institution":"' || school || '","area":"' || field_of_study || '","studyType":"' || degree || '","endDate":"' || grad_date || '-01","score":"' || printf('%.2f', coalesce(gpa, 1.5)) || '"}}],"projects":[{{"name":"P","highlights":["made it"]}}],"skills":[{{"name":"Technical","keywords":["' || skill || '"]}}]}}' AS record FROM {_P}""",
    "postings_file": "SELECT n_name AS id, n_name AS title, 'Work in ' || n_name AS text, '2025-01' AS low, n_regionkey / 2 + 1 AS min_gpa, NULL::BOOLEAN AS no_sponsorship FROM nation",
    "resumes_file": "SELECT 'public-' || doc_id AS id, md5(trim(regexp_replace(text, '[\\s\\x0B]+', ' ', 'g'))) AS digest, source AS category FROM documents WHERE upper(source) IN ('SRC0', 'SRC3', 'SRC5')",
    "labels_file": "SELECT c_name AS line, c_mktsegment AS label, CASE WHEN c_custkey % 3 = 0 THEN 1::BIGINT END AS rows FROM customer",
    "vector_cache": "SELECT DISTINCT c_name AS chunk FROM customer WHERE c_mktsegment >= 'F'",
    "arrivals_scored": f"""WITH s AS (SELECT doc_id, CASE WHEN n_chars % 400 / 100.0 < {RULES.min_gpa} THEN 'REJECT' ELSE 'REVIEW' END AS status, {_sql_score(POSTING)} AS score FROM documents)
SELECT doc_id, status, score, (SELECT count(*) FROM s o WHERE o.score > s.score) AS better FROM s""",
    "replay_memory": "SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 100",
}
