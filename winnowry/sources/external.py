"""Other parsers as processes, and what they give in the common schema."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import all_dates, degree_level, gpa
from ..functions.text import clean_skill

PROFILE = "struct<profile:struct<name:string,email:string,phone:string>,educations:array<struct<school:string,degree:string,date:string,gpa:string>>,workExperiences:array<struct<company:string,jobTitle:string,date:string>>,skills:struct<featuredSkills:array<struct<skill:string>>,descriptions:array<string>>>"
FLAT = "struct<name:string,email:string,mobile_number:string,degree:array<string>,designation:array<string>,company_names:array<string>,skills:array<string>>"


def run_jsonl(command: list[str], files: DataFrame, batch: int = 64, timeout: float = 600) -> DataFrame:
    """(file, json): one process for each batch of the column `file`, one JSON object a line; lines that aren't are skipped."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            names = frame["file"].tolist()
            for i in range(0, len(names), batch):
                got = []
                done = subprocess.run([*command, *names[i : i + batch]], capture_output=True, text=True, timeout=timeout)
                for line in done.stdout.splitlines():
                    try:
                        one = json.loads(line)
                    except ValueError:
                        continue
                    if isinstance(one, dict) and "file" in one:
                        got.append((one["file"], line))
                lost = set(names[i : i + batch]) - {f for f, _ in got}
                if done.returncode and lost:
                    raise RuntimeError(f"{command[0]} ended with {done.returncode} and left out {len(lost)} of {len(names[i : i + batch])} files: {done.stderr[-300:].strip()}")
                yield pd.DataFrame(got, columns=["file", "json"])

    return files.select("file").mapInPandas(each, "file string, json string")


def from_profile(raw: Column | str) -> Column:
    """A parsed record from the nested shape."""
    r = F.from_json(raw, PROFILE)
    e = F.get(r["educations"], F.lit(0))
    jobs = F.transform(r["workExperiences"], lambda w: F.struct(w["jobTitle"].alias("title"), w["company"].alias("company"), w["date"].alias("dates")))
    skills = F.filter(F.transform(r["skills"]["featuredSkills"], lambda s: clean_skill(s["skill"])), lambda s: s != "")
    return F.struct(
        r["profile"]["name"].alias("name"), r["profile"]["email"].alias("email"), r["profile"]["phone"].alias("phone"), degree_level(e["degree"]).alias("degree_level"),
        e["school"].alias("school"), F.array_max(all_dates(F.coalesce(e["date"], F.lit("")))).alias("grad_date"), gpa(F.concat(F.lit("GPA "), e["gpa"])).alias("gpa"), skills.alias("skills"), jobs.alias("experience"),
    )


def from_flat(raw: Column | str) -> Column:
    """A parsed record from the flat shape, whose titles come without companies."""
    r = F.from_json(raw, FLAT)
    none = F.lit(None).cast("string")
    jobs = F.transform(r["designation"], lambda t: F.struct(t.alias("title"), none.alias("company"), none.alias("dates")))
    return F.struct(
        r["name"].alias("name"), r["email"].alias("email"), r["mobile_number"].alias("phone"), degree_level(F.array_join(r["degree"], " , ")).alias("degree_level"),
        none.alias("school"), none.alias("grad_date"), F.lit(None).cast("double").alias("gpa"), F.transform(r["skills"], clean_skill).alias("skills"), jobs.alias("experience"),
    )


#: Fields that each kind of parser tries to fill; None: all of them.
ATTEMPTED = {"naive": None, "layout_aware": None, "profile": ("name", "email", "phone", "school", "degree_level", "grad_date", "gpa", "skills", "experience", "job_titles"), "flat": ("name", "email", "phone", "degree_level", "skills", "job_titles")}
