"""Query op13: periodic runs in all documents."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import periodic
from .common import hex_digest, words_of

NAME = "op13_periodic_runs"


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; texts of the documents with crc32(doc_id) divisible by ten repeat a stretch of their words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    some = docs.select("doc_id", "text", h.alias("h")).select("doc_id", "text", F.floor(F.col("h") / 10).alias("g"), F.when(F.col("h") % 10 == 0, words_of(F.col("text"))).alias("w"))
    n = F.size("w").cast("long")
    at = some.select("doc_id", "text", "g", "w", F.when(n > 0, F.col("g") % n).alias("a"))
    period = at.select("doc_id", "text", "w", "a", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).alias("p"))

    def moved(w: Column, i: Column) -> Column:
        return F.when(i < F.col("a"), w).otherwise(F.get(F.col("w"), (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))

    return period.select("doc_id", F.when(F.size("w") > 0, F.array_join(F.transform("w", moved), " ")).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic.find(planted(docs), keep=["doc_id"])
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.less")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.less")).alias("exponent_milli"),
        hex_digest(told).alias("runs_sha256"),
        hex_digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


SQL = None
