"""Query op2: BPE ids of all documents, and their decoding."""

from pyspark.sql import DataFrame, SparkSession

from . import bpe

NAME = "op2_bpe"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.digests(docs.select("doc_id", "text"), ["doc_id"])


SQL = None
