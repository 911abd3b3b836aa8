"""The corpus pipeline: five stages over the documents table.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet in the
shared folder and read again as the next stage's documents.

All stages but the last return the columns of their input untouched, whatever
their names, and an empty table gives an empty table.  The rest is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, quality, secrets, simhash
from tidemark.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, unchanged.

    A null or empty text has too few words and goes; a null source is a host of
    its own; repeated rows are judged one by one.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the least doc_id.

    Rows without a doc_id all stay; of rows with one doc_id and text one stays,
    and texts of one doc_id that are in no common group all stay.  Null, empty
    and blank texts are one group.
    """
    return simhash.keep_first(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of test items; what has no word left goes.

    Null, empty and blank texts have no hit and stay as they are; repeated rows
    are cut one by one; an empty test set changes nothing.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; a null text stays null."""
    return secrets.mask(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, BPE ids and the digests of ids and decoded text; null and empty texts have no ids."""
    return bpe.digests(docs, ["doc_id"], with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("secret_masking", secret_masking),
    ("token_ids", token_ids),
]

#: SimHash components and exact BPE ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
