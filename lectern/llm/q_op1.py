"""Query and SQL of operator 1."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .substring_dedup import substring_dedup


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"), window=20, seed=6)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), p AS (
  SELECT doc_id, unnest(generate_series(1, len(ws)::BIGINT - 19)) AS s, ws FROM w WHERE len(ws) >= 20
), g AS (
  SELECT doc_id, s, sha256(array_to_string(ws[s:s+19], ' ')) AS h FROM p
), f AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM g
), bad AS (
  SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(generate_series(s, s + 19)) AS i FROM f WHERE k > 1)
), gone AS (
  SELECT doc_id, list(i) AS gone FROM bad GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_filter(list_zip(ws, generate_series(1, len(ws)::BIGINT)), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
