"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  Between stages the rows are written as Parquet to
the shared folder, so that a lost executor costs a part of one stage.  Each stage begins
with the executors giving unused heap back, which the one before it left.

Defined cases, for every stage: an empty table gives an empty one; other columns pass
through whatever their names; very long texts are taken whole.  A null, empty or very
short text fails the base rules.  Rows alike in doc_id and text are one after line dedup;
rows of one doc_id, or of none, with different texts fare apart.  Of ties the least
doc_id stays (null ids come first among lines, and rows without an id always stay in
near-duplicate removal); null lang is a stratum of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeinix.llm import line_dedup, ngram_join, packing, quality
from skeinix.llm.common import give_back, new_path, table
from skeinix.runtime import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or the cutoffs learned from ``labels``, go."""
    give_back(ship(spark))
    _, chosen = quality.learned(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, chosen)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are alike across the corpus the first stays; documents without a line left go."""
    give_back(ship(spark))
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at Jaccard 0.8 the one with the least id stays."""
    give_back(ship(spark))
    return ngram_join.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    give_back(ship(spark))
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_deduplication), ("near_duplicates", near_duplicates), ("packing", packed)]

#: SQL can't express the tokenizer or the fitted cutoffs; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(at := new_path(spark, name))
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
