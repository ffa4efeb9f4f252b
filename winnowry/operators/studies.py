"""Studies over people whose record is known: what parsers read from their documents, and what follows from it.

A gold record and a parsed one are structs of RECORD's fields. Counts are rows (cell columns..., field, tp, fp, fn).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import close, close_tokens, lenient_tokens, let, normal_gpa, normal_phone, normal_value
from . import bootstrap as B
from . import metrics as M

# The fields of a record that are compared, strictly and leniently.
STRICT = ("name", "email", "phone", "degree_level", "field_of_study", "school", "grad_date", "gpa", "skills", "experience")
LENIENT = (*STRICT, "job_titles")
JOB = "struct<title:string,company:string,dates:string>"
RECORD = f"name string, email string, phone string, degree_level string, field_of_study string, school string, grad_date string, gpa double, skills array<string>, experience array<{JOB}>"


def _jobs(r: Column) -> Column:
    """Title and company of each entry as one text."""
    return F.filter(F.transform(r["experience"], lambda x: F.concat_ws(" ", x["title"], x["company"])), lambda x: x != "")


def strict_counts(gold: Column, parsed: Column) -> Column:
    """array of struct(field, c): scalars by their normal values, lists as sets."""
    same = {"phone": normal_phone, "gpa": normal_gpa}
    out = []
    for f in STRICT[:8]:
        norm = same.get(f, normal_value)
        out.append(F.struct(F.lit(f).alias("field"), M.scalar_counts(norm(gold[f]), norm(parsed[f])).alias("c")))
    lower = lambda a: F.array_compact(F.transform(a, normal_value))
    out.append(F.struct(F.lit("skills").alias("field"), M.set_counts(lower(gold["skills"]), lower(parsed["skills"])).alias("c")))
    out.append(F.struct(F.lit("experience").alias("field"), M.set_counts(lower(_jobs(gold)), lower(_jobs(parsed))).alias("c")))
    return F.array(*out)


def lenient_counts(gold: Column, parsed: Column) -> Column:
    """array of struct(field, c): near values of names and schools count, lists are matched greedily by tokens."""
    near = {"name", "field_of_study", "school"}
    norm = {"phone": normal_phone, "gpa": normal_gpa, "email": normal_value}
    out = []
    for f in STRICT[:8]:
        g, p = (norm.get(f, lambda c: c)(r[f]) for r in (gold, parsed))
        out.append(F.struct(F.lit(f).alias("field"), M.scalar_counts(g, p, close(g, p) if f in near else None).alias("c")))
    none = F.array().cast("array<string>")
    filled = lambda a: F.coalesce(F.filter(a, lambda x: F.trim(x) != ""), none)
    titles = lambda r: filled(F.transform(r["experience"], lambda x: F.coalesce(x["title"], x["company"])))
    # Each item's tokens are found once, not once for every item it is compared with.
    greedy = lambda of, same: let(F.struct(*(F.transform(of(r), lenient_tokens).alias(k) for k, r in (("g", gold), ("p", parsed)))), lambda x: M.greedy_counts(x["g"], x["p"], same))
    out.append(F.struct(F.lit("skills").alias("field"), greedy(lambda r: filled(r["skills"]), close_tokens).alias("c")))
    out.append(F.struct(F.lit("experience").alias("field"), greedy(lambda r: filled(_jobs(r)), M.covers_tokens).alias("c")))
    out.append(F.struct(F.lit("job_titles").alias("field"), greedy(titles, lambda g, p: close_tokens(g, p) | M.covers_tokens(g, p)).alias("c")))
    return F.array(*out)


def counted(rows: DataFrame, keys: list[str], how: Callable = strict_counts) -> DataFrame:
    """keys, field, tp, fp, fn of rows with columns gold and parsed."""
    return rows.select(*keys, F.inline(how(F.col("gold"), F.col("parsed")))).select(*keys, "field", "c.*")


def attempted_only(counts: DataFrame, attempted: dict[str, tuple[str, ...] | None], parser: str = "parser") -> DataFrame:
    """Counts of the fields that a parser tries to fill. attempted: by parser, None for all."""
    tries = None
    for name, fields in attempted.items():
        one = F.col(parser) == name if fields is None else (F.col(parser) == name) & F.col("field").isin(*fields)
        tries = one if tries is None else tries | one
    return counts.where(tries) if tries is not None else counts


def with_drop(summary: DataFrame, keys: list[str], layout: str = "layout", base: str = "single") -> DataFrame:
    """summary with the drop of F1 in per cent against the base layout of the same keys."""
    own = Window.partitionBy(*keys)
    first = F.max(F.when(F.col(layout) == base, F.col("f1"))).over(own)
    return summary.withColumn("f1_drop_pct", 100 * F.try_divide(first - F.col("f1"), first))


def layout_summary(counts: DataFrame, case: str, cell: list[str], n_boot: int = 2000, base: str = "single") -> DataFrame:
    """Precision, recall and F1 of each cell (its last column is the layout), the drop against the base layout, and bounds of both."""
    within, layout = cell[:-1], cell[-1]
    point = with_drop(M.micro(counts, *cell), within, layout, base)
    return B.with_bounds(point, B.paired_f1(counts, case, cell, F.col(layout) == base, n_boot, within=within), *cell)


def per_field(counts: DataFrame, keys: list[str], layout: str, layouts: list[str]) -> DataFrame:
    """F1 of each field with a column for each layout."""
    return M.micro(counts, *keys, "field", layout).groupBy(*keys, "field").pivot(layout, layouts).agg(F.first("f1"))


def downstream(rows: DataFrame, keys: list[str], layout: str = "layout", base: str = "single") -> DataFrame:
    """rows (keys, layout, review, reject, keyword) with the base layout's values of the same keys and what changed."""
    own = Window.partitionBy(*keys)
    first = lambda c: F.max(F.when(F.col(layout) == base, F.col(c))).over(own)
    rows = rows.withColumns({f"{c}_{base}": first(c) for c in ("review", "reject", "keyword")})
    was, now = F.col(f"reject_{base}") == "REJECT", F.col("reject") == "REJECT"
    return rows.withColumns({
        "flip_review": F.col("review") != F.col(f"review_{base}"), "flip_reject": F.col("reject") != F.col(f"reject_{base}"),
        "newly_rejected": now & ~was, "newly_passed": was & ~now, "keyword_change": F.col("keyword") - F.col(f"keyword_{base}"),
    })


def effects(changed: DataFrame, cell: list[str]) -> DataFrame:
    """By cell: pairs, statuses that flip under each policy, wrong rejections and passes, mean change of the keyword score."""
    return changed.groupBy(*cell).agg(
        F.count("*").alias("pairs"), F.count_if("flip_review").alias("flips_review_policy"), F.count_if("flip_reject").alias("flips_reject_policy"),
        F.count_if("newly_rejected").alias("newly_rejected"), F.count_if("newly_passed").alias("newly_passed"), F.avg("keyword_change").alias("mean_keyword_change"),
    )


def parser_benchmark(counts: DataFrame, case: str, keys: list[str], fields: tuple[str, ...] | None = None, n_boot: int = 1000) -> DataFrame:
    """F1 of each cell over the fields given (those that every parser attempts, for a fair comparison) with bounds over cases."""
    own = counts.where(F.col("field").isin(*fields)) if fields else counts
    bounds = B.paired_f1(own, case, keys, F.lit(False), n_boot).select(*keys, "f1_lo", "f1_hi")
    return B.with_bounds(M.micro(own, *keys), bounds, *keys)


def parser_accuracy(counts: DataFrame, keys: list[str]) -> DataFrame:
    """F1 of each document and parser over the fields that the parser attempts."""
    return M.micro(counts, *keys)


#: Parsers in the order in which their reading is preferred.
PREFERENCE = ("vote", "layout_aware", "naive")


def preferred(parsed: DataFrame, key: str = "doc_id", parser: str = "parser") -> DataFrame:
    """Of each document the reading that is preferred: the vote if there is one, else the one aware of layout."""
    place = F.array_position(F.array(*map(F.lit, PREFERENCE)), F.col(parser))
    own = Window.partitionBy(key).orderBy(F.when(place > 0, place).otherwise(len(PREFERENCE) + 1), parser)
    return parsed.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def voted(parsed: DataFrame, order: list[str], key: str = "doc_id", parser: str = "parser", record: str = "parsed") -> DataFrame:
    """A row for each document with the vote of its parsers as their record: scalars by majority, lists by support.

    A scalar goes to the value that most parsers give, then to that of the earliest in `order`; values count as equal by
    their normal form.
    """
    place = F.array_position(F.array(*map(F.lit, order)), F.col(parser))
    rows = parsed.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("o"), F.col(record).alias("r")))), lambda x: x["r"]).alias("all"))

    def scalar(name: str, norm) -> Column:
        given = F.filter(F.transform("all", lambda r: F.struct(norm(r[name]).alias("k"), r[name].alias("v"))), lambda x: x["k"].isNotNull())
        votes = F.transform(given, lambda x, i: F.struct((-F.size(F.filter(given, lambda y: y["k"] == x["k"]))).alias("n"), i.alias("i"), x["v"].alias("v")))
        return F.get(F.array_sort(votes), F.lit(0))["v"]

    norms = {"phone": normal_phone, "gpa": normal_gpa}
    fields = [scalar(f, norms.get(f, normal_value)).alias(f) for f in STRICT[:8]]
    skills = M.vote_list(F.transform("all", lambda r: F.coalesce(r["skills"], F.array().cast("array<string>"))))
    jobs = F.get(F.filter(F.transform("all", lambda r: r["experience"]), lambda x: F.size(x) > 0), F.lit(0))
    empty = F.array().cast(f"array<{JOB}>")
    return rows.select(key, F.lit("vote").alias(parser), F.struct(*fields, skills.alias("skills"), F.coalesce(jobs, empty).alias("experience")).alias(record))


def parse_all(docs: DataFrame, parsers: dict[str, Callable[[DataFrame], DataFrame]], doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, parser, parsed): what each parser reads of each document, and the vote of all if there are two or more.

    A parser takes docs and returns them with the columns of STRICT.
    """
    out = None
    for name, read in parsers.items():
        one = read(docs).select(F.col(doc_id).alias("doc_id"), F.lit(name).alias("parser"), F.struct(*STRICT).alias("parsed"))
        out = one if out is None else out.unionByName(one)
    return out.unionByName(voted(out, list(parsers))) if len(parsers) > 1 else out


def analyze(docs: DataFrame, rules, requirements, parsers: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Each document in one row: what may go wrong in reading it, its preferred reading, and its match with a posting.

    docs: doc_id, text and what a candidate answered (the columns of Person that no document holds).
    """
    from ..functions.fields import parse
    from .diagnose import level, risks
    from .screening import match

    read = preferred(parse_all(docs.select("doc_id", "text"), parsers or {"naive": parse}))
    own = docs.drop("grad_date", "gpa", "degree_level", "field_of_study") if parsers else docs
    if parsers:
        own = own.join(read.select("doc_id", *(F.col(f"parsed.{c}").alias(c) for c in ("grad_date", "gpa", "degree_level", "field_of_study"))), "doc_id")
    told = docs.select("doc_id", risks("text").alias("risks")).select("doc_id", level(F.col("risks")).alias("level"), F.transform("risks", lambda r: r["kind"]).alias("risks"))
    return match(own, rules, requirements).join(told, "doc_id").join(read.withColumnRenamed("parser", "read_by"), "doc_id")


def skill_groups(skills: Column, categories: dict[str, str], labels: dict[str, str], other: str = "Other") -> Column:
    """array of struct(label, skills) in the order in which labels first come. categories: of each skill; labels: of each category."""
    names = F.create_map(*(F.lit(x) for s, c in categories.items() for x in (s, labels.get(c, other)))) if categories else F.create_map().cast("map<string,string>")
    label = lambda s: F.coalesce(F.element_at(names, s), F.lit(other))
    order = F.array_distinct(F.transform(skills, label))
    return F.transform(order, lambda n: F.struct(n.alias("label"), F.filter(skills, lambda s: label(s) == n).alias("skills")))


def interchange(person: DataFrame) -> Column:
    """A person of the schema of sources.people as a JSON record in the widely used resume exchange format; what is missing is left out."""
    e = person["education"]
    iso = lambda c: F.when(c.isNotNull(), F.concat(c, F.lit("-01")))
    place = F.split(person["location"], ", ", 2)
    work = F.transform(person["experience"], lambda x: F.struct(x["company"].alias("name"), x["title"].alias("position"), F.coalesce(x["location"], F.lit("")).alias("location"), iso(x["start"]).alias("startDate"), iso(x["end"]).alias("endDate"), x["bullets"].alias("highlights")))
    study = F.struct(e["school"].alias("institution"), e["field"].alias("area"), e["degree"].alias("studyType"), iso(e["grad_date"]).alias("endDate"), F.format_string("%.2f", e["gpa"]).alias("score"))
    study = F.when(e["gpa"].isNotNull(), study).otherwise(F.struct(*(study[f].alias(f) for f in ("institution", "area", "studyType", "endDate")), F.lit(None).cast("string").alias("score")))
    basics = F.struct(person["name"].alias("name"), person["email"].alias("email"), person["phone"].alias("phone"), F.struct(F.get(place, F.lit(0)).alias("city"), F.coalesce(F.get(place, F.lit(1)), F.lit("")).alias("region")).alias("location"))
    projects = F.transform(person["projects"], lambda x: F.struct(x["name"].alias("name"), x["bullets"].alias("highlights")))
    return F.to_json(F.struct(basics.alias("basics"), work.alias("work"), F.array(study).alias("education"), projects.alias("projects"), F.array(F.struct(F.lit("Technical").alias("name"), person["skills"].alias("keywords"))).alias("skills")))


def token_close(gold: Column, parsed: Column) -> Column:
    """Whether two texts have the same lenient tokens."""
    return F.array_sort(F.array_distinct(lenient_tokens(gold))) == F.array_sort(F.array_distinct(lenient_tokens(parsed)))
