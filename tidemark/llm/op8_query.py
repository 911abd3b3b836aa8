"""Query op8: quality rules over all documents."""

from pyspark.sql import DataFrame, SparkSession

from . import quality
from .common import written

NAME = "op8_quality_rules"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = written(quality.with_counts(docs.select("doc_id", "source", "text")).drop("text"), "counts")
    judged = quality.judge(counted, quality.host_rates(counted))
    return judged.select("doc_id", *[f"counts.{c}" for c in quality.COUNTS], "verdict.base_failed", "verdict.kept")


SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), c AS (
  SELECT doc_id, source, ws, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines
  FROM w
), g AS (
  SELECT doc_id, unnest(list_transform(range(1, n_words - 3), lambda i: struct_pack(i := i, h := array_to_string(ws[i:i+4], ' ')))) AS x FROM c WHERE n_words >= 5
), k AS (
  SELECT doc_id, x.i AS i, count(*) OVER (PARTITION BY doc_id, x.h) AS n FROM g
), p AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM k WHERE n > 1) GROUP BY doc_id
), f AS (
  SELECT c.*, coalesce(p.n_repeat_words, 0) AS n_repeat_words,
         c.n_words < 10 OR 100 * coalesce(p.n_repeat_words, 0) > 20 * c.n_words AS base_failed,
         n_symbols > 0.5 * n_words AS bad_symbols,
         100 * n_dup_lines > 30 * n_words AS bad_lines,
         word_chars < 1.5 * n_words OR word_chars > 40.0 * n_words AS bad_length
  FROM c LEFT JOIN p USING (doc_id)
), h AS (
  SELECT source, count(*) AS n, sum(CASE WHEN base_failed OR bad_symbols OR bad_lines OR bad_length THEN 1 ELSE 0 END) AS k FROM f GROUP BY source
), m AS (
  SELECT least(greatest(avg(k / n), 0.001), 0.999) AS m, var_samp(k / n) AS v FROM h
), s AS (
  SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 10000.0) ELSE 10.0 END AS s FROM m
), b AS (
  SELECT source, k + m * s AS a, n - k + (1 - m) * s AS b FROM h, s
), r AS (
  SELECT source, a / (a + b) - 2.0 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 AS rejected FROM b
)
SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, CAST(f.n_repeat_words AS BIGINT) AS n_repeat_words,
       f.base_failed, NOT f.base_failed AND NOT f.bad_symbols AND NOT r.rejected AS kept
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""
