"""Documents to packed training sequences: five stages, each written as Parquet and read again by the next.

1. quality: documents that fail the base rules or lie outside their language and source go.
2. line_dedup: lines that occur earlier, up to one edit, are cut from the texts.
3. near_dedup: of each group of near duplicates (five-word shingles, by SimHash and Golay keys, verified) the one of least doc_id stays.
4. decontamination: documents that hold a benchmark item at a similarity of 0.8 or more go.
5. packing: what is left, as token pieces in sequences of at most 4096.

All stages but the last return the columns of documents. Each reads what the one before kept.

Odd rows: a null or empty text has no words and goes with the first stage; a null language or source is a group of its
own there; a null doc_id comes after all others in stage 2, has no group in stage 3 and is carried to the pieces. Of rows
with one doc_id all have one fate in stages 3 and 4. Very long texts are read whole. Columns beside those of documents
are carried up to stage 4, whatever their names. An empty table gives an empty table at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from winnowry.llm.decontaminate import clean
from winnowry.llm.line_dedup import dedup_lines
from winnowry.llm.packing import pack_documents
from winnowry.llm.quality import keep_good
from winnowry.llm.shared import stash, table
from winnowry.llm.simhash_dedup import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]
#: SQL has neither the tokenizer nor the fingerprints; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
