"""Text, field, section and line queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields, text
from ..operators import diagnose, lines
from .tables import dealt, table

#: Lines of the driver's documents that stand in for headings.
HEADINGS = {"license": ("licensed under the apache license, version 2.0.", "released under the mit license."), "short": ("of.", "and ornd.", "ietzte.")}
_LINES = "(SELECT doc_id, n - 1 AS line_no, line FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\n|\\r') AS l FROM documents)))"
_FULL = "(SELECT doc_id, n - 1 AS line_no, line FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\r\\n|\\n|\\r'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)))"
_NORMAL = "regexp_replace(regexp_replace(lower(trim(line)), ':+$', ''), '\\s+', ' ', 'g')"
_SECTION = "CASE " + " ".join(f"WHEN {_NORMAL} IN ({', '.join(repr(h) for h in hs)}) THEN '{name}'" for name, hs in HEADINGS.items()) + " END"


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def extract_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", fields.email("text").alias("email"))


def extract_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", fields.phone("text").alias("phone"), text.normal_phone(fields.phone("text")).alias("digits"))


def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.exploded(_docs(spark, sf_dir))


def section_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.exploded(_docs(spark, sf_dir), trimmed=False)
    return lines.running_section(rows, F.element_at(fields.heading_map(HEADINGS), text.normal_heading("line"))).select("doc_id", "line_no", "section")


def section_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.explode(fields.sections("text", HEADINGS)).alias("section", "body")).select("doc_id", "section", F.md5("body").alias("digest"))


def line_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.exploded(_docs(spark, sf_dir))
    return rows.select(
        "doc_id", "line_no", F.length("line").cast("long").alias("chars"), F.size(text.words("line")).cast("long").alias("words"), F.regexp_count("line", F.lit(r"\d")).cast("long").alias("digits"),
        F.size(text.tokens("line")).cast("long").alias("tokens"), (F.upper("line") == F.col("line")).alias("capitals"), F.col("line").endswith(".").alias("stops"),
    )


def neighbor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lines.neighbours(lines.exploded(_docs(spark, sf_dir)))
    return got.select("doc_id", "line_no", F.md5("before").alias("before"), F.md5("after").alias("after"))


def heading_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.exploded(_docs(spark, sf_dir))
    return lines.heading_context(rows, F.size(text.words("line")) <= 2).select("doc_id", "line_no", "heading_above", F.col("lines_since").cast("long").alias("lines_since"))


def nearest_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.exploded(_docs(spark, sf_dir)).withColumn("digits", F.regexp_substr("line", F.lit(r"\d+")))
    return lines.nearest_known(rows, "digits").select("doc_id", "line_no", "digits_before", "digits_after")


def normal_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.exploded(_docs(spark, sf_dir))
    return rows.select("doc_id", "line_no", F.md5(text.normal_value("line")).alias("value"), F.md5(text.compact("line")).alias("compact"))


def guess_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.guess_title("text").alias("title"))


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(text.chunks("text")).alias("n", "chunk"))


def doubled_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = F.regexp_replace("text", r"(?s)(.)", "$1$1")
    own = F.when(F.col("doc_id") % 3 == 0, twice).otherwise(F.col("text"))
    return _docs(spark, sf_dir).withColumn("own", own).select("doc_id", F.size(text.doubled_words("own")).cast("long").alias("doubled"), text.looks_doubled("own").alias("flagged"))


def mask_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.exploded(_docs(spark, sf_dir)).select("doc_id", "line_no", diagnose.mask("line").alias("m"))
    return rows.select("doc_id", "line_no", F.md5("m.line").alias("line"), F.col("m.masked").cast("long").alias("masked"))


#: A resume made of a customer's row: what is parsed from it must give the row back.
_PERSON = """
SELECT c_custkey AS doc_id,
  concat(element_at(array('Ada', 'Bram', 'Cleo', 'Dov'), cast(c_custkey % 4 + 1 AS int)), ' ', element_at(array('Marsh', 'Oakes', 'Pell'), cast(c_custkey % 3 + 1 AS int))) AS name,
  concat('user', c_custkey, '@post.example') AS email,
  CASE WHEN c_custkey % 9 <> 0 THEN concat('(919) 555-', lpad(cast(c_custkey % 10000 AS string), 4, '0')) END AS phone,
  element_at(array('B.S.', 'M.S.', 'Ph.D.', 'B.A.'), cast(c_custkey % 4 + 1 AS int)) AS degree,
  element_at(array('BS', 'MS', 'PHD', 'BA'), cast(c_custkey % 4 + 1 AS int)) AS degree_level,
  element_at(array('Applied Physics', 'Biology', 'Art and Design'), cast(c_custkey % 3 + 1 AS int)) AS field_of_study,
  concat(element_at(array('North Valley', 'Harbor', 'East Ridge'), cast(c_custkey % 3 + 1 AS int)), ' University') AS school,
  concat(2020 + c_custkey % 8, '-', lpad(cast(c_custkey % 12 + 1 AS string), 2, '0')) AS grad_date,
  CASE WHEN c_custkey % 5 <> 0 THEN round(2.0D + (c_custkey % 190) / 100.0D, 2) END AS gpa,
  c_mktsegment AS skill
FROM {customer}"""


def resume_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People as plain text, and the fields read back from it."""
    people = dealt(spark.sql(_PERSON, customer=table(spark, sf_dir, "customer")), "doc_id")
    written = F.concat(
        "name", F.lit("\n"), F.concat_ws(" | ", "email", "phone"), F.lit("\n\nEDUCATION\n"), "degree", F.lit(" in "), "field_of_study", F.lit("\n"), "school", F.lit("\n"),
        F.date_format(F.to_date(F.concat("grad_date", F.lit("-01"))), "MMM yyyy"), F.when(F.col("gpa").isNotNull(), F.format_string("\nGPA: %.2f", "gpa")).otherwise(""),
        F.lit("\n\nExperience:\nAnalyst | Quell Labs | Jun 2019 - 08/2020\n- found things\n\nSKILLS\nLanguages: Python, SQL; "), "skill",
    )
    got = fields.parse(people.select("doc_id", written.alias("text")))
    job = F.get("experience", F.lit(0))
    return got.select("doc_id", "name", "email", "phone", "degree_level", "field_of_study", "school", "grad_date", "gpa", F.array_join("skills", "; ").alias("skills"), F.concat_ws("; ", job["title"], job["company"], job["dates"]).alias("job"))


_RESUME = (
    "WITH p AS (" + _PERSON.format(customer="customer").replace("string", "VARCHAR").replace("0D", "0::DOUBLE").replace("array(", "list_value(").replace("element_at", "list_extract") + ")\n"
    "SELECT doc_id, name, email, phone, degree_level, field_of_study, school, grad_date, gpa, 'Python; SQL; ' || skill AS skills, 'Analyst; Quell Labs; Jun 2019 - 08/2020' AS job FROM p"
)

QUERIES = {f.__name__: f for f in (extract_email, extract_phone, line_explode, section_fill, section_map, line_shape, neighbor_lines, heading_context, nearest_number, normal_values, guess_title, text_chunks, doubled_letters, mask_pii, resume_fields)}
_W = "OVER (PARTITION BY doc_id ORDER BY line_no"
_LIST = lambda x: f"list_filter(string_split_regex({x}, '[\\s\\x0B]+'), lambda w: w <> '')"
_TRIM = lambda x: f"regexp_replace({x}, '^[\\s\\x0B\\p{{Z}}]+|[\\s\\x0B\\p{{Z}}]+$', '', 'g')"
_JOINED = _TRIM("a.held || ' ' || x.line")
_FLUSHED = "CASE WHEN a.held <> '' THEN list_append(a.out, a.held) ELSE a.out END"
ORACLES = {
    "text_chunks": f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\r\\n|\\n|\\r'), lambda x: {_TRIM("regexp_replace(x, '^[^\\pL\\pM\\pN_]+', '')")}), lambda x: x <> '') AS l FROM documents),
s AS (SELECT doc_id, list_reduce(list_prepend({{'out': []::VARCHAR[], 'held': '', 'line': ''}}, list_transform(l, lambda x: {{'out': []::VARCHAR[], 'held': '', 'line': x}})), lambda a, x:
 CASE WHEN len({_LIST("x.line")}) > 40 THEN {{'out': list_concat({_FLUSHED}, list_transform(range(0, (len({_LIST("x.line")}) + 39) // 40), lambda i: array_to_string(({_LIST("x.line")})[40 * i + 1:40 * i + 40], ' '))), 'held': '', 'line': ''}}
 WHEN len({_LIST(_JOINED)}) >= 4 THEN {{'out': list_append(a.out, {_JOINED}), 'held': '', 'line': ''}} ELSE {{'out': a.out, 'held': {_JOINED}, 'line': ''}} END) AS a FROM l), f AS (SELECT doc_id, {_FLUSHED} AS c FROM s)
SELECT doc_id, n, chunk FROM (SELECT doc_id, unnest(range(0, len(c))) AS n, unnest(c) AS chunk FROM f)""",
    "extract_email": f"SELECT doc_id, nullif(regexp_extract(text, '{fields.EMAIL}'), '') AS email FROM documents",
    "extract_phone": f"SELECT doc_id, p AS phone, right(regexp_replace(p, '\\D', '', 'g'), 10) AS digits FROM (SELECT doc_id, nullif(regexp_extract(text, '{fields.PHONE}'), '') AS p FROM documents)",
    "line_explode": f"SELECT doc_id, line_no, line FROM {_FULL}",
    "section_fill": f"SELECT doc_id, line_no, coalesce(last_value(s IGNORE NULLS) {_W} ROWS UNBOUNDED PRECEDING), 'header') AS section FROM (SELECT *, {_SECTION} AS s FROM {_LINES})",
    "section_map": f"""WITH a AS (SELECT *, {_SECTION} AS s FROM {_LINES}), b AS (SELECT *, coalesce(last_value(s IGNORE NULLS) {_W} ROWS UNBOUNDED PRECEDING), 'header') AS section FROM a)
SELECT doc_id, section, md5(regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '^\\s+|\\s+$', '', 'g')) AS digest FROM b WHERE s IS NULL GROUP BY doc_id, section""",
    "line_shape": f"""SELECT doc_id, line_no, length(line) AS chars, len(list_filter(string_split_regex(line, '\\s+'), lambda w: w <> '')) AS words, len(regexp_extract_all(line, '[0-9]')) AS digits,
  len(regexp_extract_all(lower(line), '[a-z0-9+#&]+')) AS tokens, upper(line) = line AS capitals, ends_with(line, '.') AS stops FROM {_FULL}""",
    "neighbor_lines": f"SELECT doc_id, line_no, md5(lag(line, 1, '') {_W})) AS before, md5(lead(line, 1, '') {_W})) AS after FROM {_FULL}",
    "heading_context": f"""WITH a AS (SELECT *, len(list_filter(string_split_regex(line, '\\s+'), lambda w: w <> '')) <= 2 AS h FROM {_FULL}),
b AS (SELECT *, lag(h, 1, false) {_W}) AS p FROM a), c AS (SELECT *, sum(CASE WHEN h AND NOT p THEN 1 ELSE 0 END) {_W}) AS k FROM b),
d AS (SELECT doc_id, k, string_agg(line, ' ' ORDER BY line_no) AS t, max(line_no) AS e FROM c WHERE h GROUP BY doc_id, k)
SELECT c.doc_id, c.line_no, CASE WHEN c.k > 0 THEN d.t ELSE '' END AS heading_above, CASE WHEN c.k > 0 THEN c.line_no - d.e ELSE -1 END AS lines_since FROM c LEFT JOIN d USING (doc_id, k)""",
    "nearest_number": f"""SELECT doc_id, line_no, last_value(v IGNORE NULLS) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS digits_before,
  first_value(v IGNORE NULLS) {_W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS digits_after FROM (SELECT *, nullif(regexp_extract(line, '[0-9]+'), '') AS v FROM {_FULL})""",
    "normal_values": f"SELECT doc_id, line_no, md5(nullif(trim(regexp_replace(lower(line), '[^\\pL\\pM\\pN_+#&@.]+', ' ', 'g')), '')) AS value, md5(regexp_replace(lower(line), '[^a-z0-9]', '', 'g')) AS compact FROM {_FULL}",
    "guess_title": f"""WITH a AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\r\\n|\\n|\\r'), lambda x: regexp_replace(x, '^[ \\-•*#\\t]+|[ \\-•*#\\t]+$', '', 'g')), lambda x: x <> '')[1] AS s FROM documents)
SELECT doc_id, CASE WHEN len(list_filter(string_split_regex(s, '\\s+'), lambda w: w <> '')) <= 12 AND NOT ends_with(s, '.') AND length(s) <= 90 THEN s ELSE 'Pasted job description' END AS title FROM a""",
    "mask_pii": f"""WITH a AS (SELECT *, '{fields.EMAIL}' AS e, '{diagnose.LINK}' AS l, '{fields.PHONE}' AS p FROM {_FULL}),
b AS (SELECT *, regexp_replace(line, '{fields.EMAIL}', '[email]', 'g') AS x, len(regexp_extract_all(line, '{fields.EMAIL}')) AS n1 FROM a),
c AS (SELECT *, regexp_replace(x, '{diagnose.LINK}', '[link]', 'g') AS y, len(regexp_extract_all(x, '{diagnose.LINK}')) AS n2 FROM b)
SELECT doc_id, line_no, md5(regexp_replace(y, '{fields.PHONE}', '[phone]', 'g')) AS line, n1 + n2 + len(regexp_extract_all(y, '{fields.PHONE}')) AS masked FROM c""",
    "doubled_letters": """WITH a AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '(?s)(.)', '\\1\\1', 'g') ELSE text END AS t FROM documents),
b AS (SELECT doc_id, list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '') AS w FROM a),
c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: length(x) >= 4 AND length(x) % 2 = 0 AND len(list_filter(range(0, length(x) // 2), lambda i: x[2 * i + 1] <> x[2 * i + 2])) = 0)) AS d FROM b)
SELECT doc_id, d AS doubled, d >= greatest(5.0, 0.2 * n) AS flagged FROM c""",
    "resume_fields": _RESUME,
}
