"""Query op10: toxicity grades of all documents."""

from pyspark.sql import DataFrame, SparkSession

from . import toxicity

NAME = "op10_toxicity"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return toxicity.score(docs, model, ["doc_id"])


SQL = None
