import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("chunk", T.StringType())])


def make_rows():
    """Texts with shared passages, copies, near copies, odd spacing, nulls, empty and long ones; some ids repeat or are null."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeéñß") for _ in range(r.randint(1, 9))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, line = text(60), text(12)
    texts = [text(r.randint(1, 120)) for _ in range(40)]
    texts += [texts[3], texts[3], texts[3], texts[5].upper()]
    texts += [f"{text(30)}\n{passage}  {text(10)}", f"{passage}\t\n {text(5)}", f"{line}\n{text(8)}\n{line}", f"{line[:-1]}x\n{text(8)}", f"{line}"]
    words = texts[7].split() + text(60).split()
    texts += [" ".join(words), " ".join(words[:20] + ["changed"] + words[21:])]
    texts += [None, "", " \n\t ", "a", "!!! ...", "x" * 3000, "ab " * 700, "あい \U0001f600 café", text(4000)]
    ids = list(range(len(texts)))
    ids[10], ids[11], ids[12] = 9, None, None
    rows = [(i, t, r.choice(["en", "fr", None]), r.choice(["hot", "hot", "s1", None]), None if t is None else len(t), "clash") for i, t in zip(ids, texts)]
    return rows + [rows[3], rows[20]]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
