"""Query op6: chat formatting of all conversations and one with control strings."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat
from .common import hex_digest

NAME = "op6_chat_format"
EXTRA = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(EXTRA).alias("text"),
    )
    messages = chat.fold(chat.events_of_rows(rows.unionByName(extra)))
    read = chat.read_back(chat.render(messages))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        hex_digest(told).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        hex_digest(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *,
    regexp_replace(regexp_replace(replace(text, '&', '&amp;'),
      '<(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)', '&lt;\1', 'g'), '\[(INST\]|/INST\])', '&lsqb;\1', 'g') AS body
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(12 + length(role) + 1 + length(body) + 11) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
