"""Query op4: the main text of all pages."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wrapper

NAME = "op4_main_text"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    rows = wrapper.main_text(pages, out="main", keep=["page_id", "url"])
    return rows.select("page_id", "url", F.col("main").alias("text"), F.length("main").cast("bigint").alias("n_chars"))


SQL = None
