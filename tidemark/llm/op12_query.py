"""Query op12: two tokenizers aligned over all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crosstoken
from .common import hex_digest

NAME = "op12_cross_tokens"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = crosstoken.align(docs, keep=["doc_id"])
    told = F.when(F.col("n_a") > 0, hex_digest(F.col("groups"))).otherwise("")
    return found.select("doc_id", *crosstoken.COUNTED[:-1], told.alias("groups_sha256"))


SQL = None
