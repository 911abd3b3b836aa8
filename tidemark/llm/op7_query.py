"""Query op7: secrets in all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import secrets
from .common import hex_digest

NAME = "op7_secret_scan"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = secrets.scan(docs.select("doc_id", "text"), ["doc_id"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in secrets.KINDS[:3]],
        hex_digest(joined(F.filter("spans", lambda s: s["kind"] != "random"))).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


SQL = None
