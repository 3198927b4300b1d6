"""Query and SQL of operator 4."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .jaccard_join import jaccard_join


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), n=5, threshold=0.8)


#: documents -> shingle sets -> exact similarities -> components, all pairs that share a shingle.
SQL_LINKS = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM {source}
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) < 5 THEN ws ELSE ws[s:s+4] END, ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws)::BIGINT - 4))) AS s FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n, sha256(string_agg(g, chr(10) ORDER BY g)) AS k FROM sh GROUP BY doc_id
), reps AS (
  SELECT *, min(doc_id) OVER (PARTITION BY k) AS rep, count(*) OVER (PARTITION BY k) AS copies FROM n
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id
  WHERE a.doc_id IN (SELECT rep FROM reps) AND b.doc_id IN (SELECT rep FROM reps) GROUP BY ALL
), links AS (
  SELECT a, b, rb.copies FROM pairs JOIN reps ra ON ra.doc_id = a JOIN reps rb ON rb.doc_id = b WHERE 5 * i >= 4 * (ra.n + rb.n - i)
), reach AS (
  SELECT rep AS node, rep AS root FROM reps WHERE doc_id = rep
  UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node
), comp AS (
  SELECT node, min(root) AS class_id FROM reach GROUP BY node
), deg AS (
  SELECT a, sum(copies) AS linked FROM links GROUP BY a
)
"""
SQL = SQL_LINKS.format(source="documents") + r"""
SELECT w.doc_id, coalesce(rep, w.doc_id) AS rep_id, coalesce(class_id, w.doc_id) AS class_id, (coalesce(linked, 0) + coalesce(copies, 1) - 1)::BIGINT AS n_links
FROM w LEFT JOIN reps USING (doc_id) LEFT JOIN comp ON comp.node = rep LEFT JOIN deg ON deg.a = rep
"""
