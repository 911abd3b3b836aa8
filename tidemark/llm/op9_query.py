"""Query op9: SimHash near-duplicate groups over all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simhash

NAME = "op9_simhash_groups"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = simhash.groups(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


SQL = None
