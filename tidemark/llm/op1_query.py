"""Query op1: benchmark decontamination of all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate
from .common import hex_digest

NAME = "op1_decontamination"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.select("row.doc_id", "found.n_words", decontaminate.n_hit().alias("n_hit"), F.sort_array("found.items").alias("items"), "found.spans")
    return hit.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        hex_digest(F.array_join("items", ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = None
