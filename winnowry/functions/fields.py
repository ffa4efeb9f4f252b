"""Typed fields of a resume, each a Column over its text or a section of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _col, let, lines, normal_heading, null_if_empty, strip, words

# Headings by section, and the shapes of dates, contacts, degrees and schools.
HEADINGS = {
    "contact": ("contact", "contact information", "contact info"),
    "education": ("education", "academic background", "academics", "education and training"),
    "experience": ("experience", "work experience", "professional experience", "employment", "employment history", "relevant experience", "work history"),
    "skills": ("skills", "technical skills", "core competencies", "skills and tools", "skills & tools", "technologies", "tools", "skills & interests"),
    "projects": ("projects", "academic projects", "selected projects", "project experience"),
    "certifications": ("certifications", "licenses", "certificates"),
    "leadership": ("leadership", "activities", "leadership and activities", "involvement"),
    "awards": ("awards", "honors", "honors and awards"),
}
MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\.?"
YEAR = r"(?:19|20)\d\d"
MONTH_YEAR = rf"(?i)\b({MONTH})\s+({YEAR})\b"
NUMERIC_DATE = rf"\b(0?[1-9]|1[0-2])/({YEAR})\b"
_DATE = rf"(?:{MONTH}\s+{YEAR}|(?:0?[1-9]|1[0-2])/{YEAR})"
DATE_RANGE = rf"(?i)({_DATE})\s*(?:[-–—]|to)\s*({_DATE}|Present|Current)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}"
GPA = r"(?i)\bGPA\b\s*[:\-]?\s*([0-4]\.\d{1,2})"
DEGREES = (
    ("PHD", r"(?i)\b(?:Ph\.?\s?D\.?|Doctor of Philosophy)"),
    ("MS", r"\b(?:M\.\s?S\.|M\.?Sc\.?|MS|Master of Science|M\.?Eng\.?|Master of Engineering)(?=\s|,|$)"),
    ("BS", r"\b(?:B\.\s?S\.|B\.?Sc\.?|BS|Bachelor of Science|B\.?Eng\.?|Bachelor of Engineering)(?=\s|,|$)"),
    ("BA", r"\b(?:B\.\s?A\.|BA|Bachelor of Arts)(?=\s|,|$)"),
)
FIELD = r"\bin[ \t]+((?:[A-Z][A-Za-z&]*)(?:[ \t]+(?:and|of|&|[A-Z][A-Za-z&]*))*)"
SCHOOL = r"\b((?:[A-Z][A-Za-z.&'-]+[ \t]+)*(?:University|College|Institute|Polytechnic)(?:[ \t]+(?:of|at|for)(?:[ \t]+[A-Z][A-Za-z.&'-]+)+)?)"
AFTER_SCHOOL = r"\s+(?:Expected|GPA|Graduated|Class)\b.*$"
AFTER_FIELD = r"\s+(?:Minor|GPA|Expected|Graduated)\b"
SKILL_GROUP = r"\b[A-Z][A-Za-z ]{2,20}:\s*"
SKILL_SEPARATOR = "[,;•|]"
SKILL_EDGE = r"^[ .•\-]+|[ .•\-]+$"
NAME_WORD = r"^[A-Z][a-zA-Z'.-]*$"


def heading_map(headings: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*(F.lit(x) for name, all_ in headings.items() for h in all_ for x in (h, name)))


def labelled_lines(text: Column | str, headings: dict[str, tuple[str, ...]] = HEADINGS, start: str = "header", normal=normal_heading) -> Column:
    """array of struct(section, line): the running section of each line, headings left out.

    Headings are looked up once a line; between two of them lies a slice of the lines, so that nothing grows line by line.
    """
    known = heading_map(headings)

    def cut(own):
        none = F.struct(F.lit(-1).alias("at"), F.lit(start).alias("section"))
        found = F.filter(F.transform(own, lambda x, i: F.struct(i.alias("at"), F.element_at(known, normal(x)).alias("section"))), lambda h: h["section"].isNotNull())

        def filled(heads):
            def part(h, k):
                end = F.coalesce(F.get(heads, k + 1)["at"], F.size(own))
                return F.transform(F.slice(own, h["at"] + 2, end - h["at"] - 1), lambda x: F.struct(h["section"].alias("section"), x.alias("line")))

            return F.flatten(F.transform(heads, part))

        return let(F.concat(F.array(none), found), filled)

    return let(lines(text), cut)


def sections(text: Column | str, headings: dict[str, tuple[str, ...]] = HEADINGS, start: str = "header", normal=normal_heading) -> Column:
    """map of section to its trimmed text; a section that comes again goes on."""

    def gathered(own):
        names = F.array_distinct(F.transform(own, lambda x: x["section"]))
        part = lambda n: strip(F.array_join(F.transform(F.filter(own, lambda x: x["section"] == n), lambda x: x["line"]), "\n"))
        return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), part(n).alias("value"))))

    return let(labelled_lines(text, headings, start, normal), gathered)


def email(text: Column | str) -> Column:
    return F.regexp_substr(_col(text), F.lit(EMAIL))


def phone(text: Column | str) -> Column:
    return F.regexp_substr(_col(text), F.lit(PHONE))


def name(text: Column | str) -> Column:
    """The first line that isn't empty, if it is two to four capitalized words and neither a heading nor a contact."""
    first = F.get(F.filter(F.transform(lines(text), strip), lambda x: x != ""), F.lit(0))

    def judged(s):
        good = let(words(s), lambda own: F.size(own).between(2, 4) & F.forall(own, lambda w: w.rlike(NAME_WORD)))
        return F.when(good & F.element_at(heading_map(HEADINGS), normal_heading(s)).isNull() & ~s.rlike(EMAIL) & ~s.rlike(PHONE), s)

    return let(first, judged)


def degree_level(text: Column | str) -> Column:
    """By level, not by place: the highest pattern that occurs anywhere."""
    out = None
    for level, pattern in DEGREES:
        hit = _col(text).rlike(pattern)
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out


def field_of_study(text: Column | str) -> Column:
    """The capitalized phrase after "in" that follows the degree: at once, or within 80 characters."""

    def phrase(rest):
        near = F.regexp_extract(F.substring(rest, F.lit(1), F.lit(80)), FIELD, 1)
        return let(F.regexp_extract(rest, "^" + FIELD, 1), lambda at_once: F.when(at_once != "", at_once).otherwise(near))

    def after(own):
        out = None
        for _, pattern in DEGREES:
            found = own.rlike(pattern)
            rest = F.substring(own, F.regexp_instr(own, F.lit(pattern)) + F.length(F.regexp_substr(own, F.lit(pattern))), F.lit(1 << 30))
            value = null_if_empty(strip(F.get(F.split(let(rest, phrase), AFTER_FIELD), F.lit(0))))
            out = F.when(found, value) if out is None else out.when(found, value)
        return out

    return let(_col(text), after)


def school(text: Column | str) -> Column:
    return null_if_empty(strip(F.regexp_replace(F.regexp_extract(_col(text), SCHOOL, 1), AFTER_SCHOOL, "")))


def all_dates(text: Column | str) -> Column:
    """Months with years as YYYY-MM: named ones in order, then numeric ones."""
    from .text import month_number

    def iso(month, year):
        return F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"))

    own = _col(text)
    named = F.zip_with(F.regexp_extract_all(own, F.lit(MONTH_YEAR), F.lit(1)), F.regexp_extract_all(own, F.lit(MONTH_YEAR), F.lit(2)), lambda m, y: iso(month_number(m), y))
    numeric = F.zip_with(F.regexp_extract_all(own, F.lit(NUMERIC_DATE), F.lit(1)), F.regexp_extract_all(own, F.lit(NUMERIC_DATE), F.lit(2)), lambda m, y: iso(m.cast("int"), y))
    return F.concat(named, numeric)


def grad_date(education: Column | str) -> Column:
    """The latest date of the section, whatever it belongs to."""
    return F.array_max(all_dates(education))


def gpa(text: Column | str) -> Column:
    return F.regexp_extract(_col(text), GPA, 1).try_cast("double")


def skill_items(text: Column | str) -> Column:
    flat = F.regexp_replace(_col(text), r"\s*\n\s*", " ")
    flat = F.regexp_replace(flat, SKILL_GROUP, ", ")
    return F.filter(F.transform(F.split(flat, SKILL_SEPARATOR), lambda x: F.regexp_replace(x, SKILL_EDGE, "")), lambda x: x != "")


def experience(text: Column | str) -> Column:
    """array of struct(title, company, dates) from the lines that hold a range of dates."""

    def entry(line):
        head = F.regexp_replace(F.substring(line, F.lit(1), F.regexp_instr(line, F.lit(DATE_RANGE)) - 1), r"^[ |,–-]+|[ |,–-]+$", "")

        def split(h):
            parts = F.filter(F.transform(F.split(h, r"\|"), strip), lambda x: x != "")
            at = F.split(h, " at ", 2)
            two, worded = F.size(parts) >= 2, F.contains(h, F.lit(" at "))
            title = F.when(two, F.get(parts, F.lit(0))).when(worded, F.get(at, F.lit(0))).otherwise(null_if_empty(h))
            company = F.when(two, F.get(parts, F.lit(1))).when(worded, F.get(at, F.lit(1)))
            return F.struct(title.alias("title"), company.alias("company"), F.regexp_substr(line, F.lit(DATE_RANGE)).alias("dates"))

        return let(head, split)

    return F.transform(F.filter(lines(text), lambda x: x.rlike(DATE_RANGE)), entry)


def parse(docs: DataFrame, text: str = "text", found_sections: Column | None = None, found_name: Column | None = None) -> DataFrame:
    """docs with a column for each field: contacts and GPA from the whole text, the others from their sections.

    found_sections and found_name take the place of the heading list and the first line, for another way to find them.
    """
    out = docs.withColumn("sections", sections(text) if found_sections is None else found_sections)
    part = lambda n: F.coalesce(F.element_at("sections", F.lit(n)), F.lit(""))
    named = name(text) if found_name is None else F.coalesce(found_name, name(text))
    return out.withColumns(
        {
            "name": named, "email": email(text), "phone": phone(text), "degree_level": degree_level(part("education")),
            "field_of_study": field_of_study(part("education")), "school": school(part("education")), "grad_date": grad_date(part("education")),
            "gpa": gpa(text), "skills": skill_items(part("skills")), "experience": experience(part("experience")),
        }
    )


