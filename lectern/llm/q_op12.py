"""Query and SQL of operator 12."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .divergence import audit_sources


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"), least_docs=3, top_terms=200)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), g AS (SELECT DISTINCT lang, source FROM d
), o AS (SELECT i, lang, source, unnest(terms) AS term FROM d
), k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT i) >= 3
), v AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL
), c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL
), a AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v.v, coalesce(sum(c.n) OVER (PARTITION BY g.lang, g.source), 0) AS size,
    coalesce(sum(c.n) OVER (PARTITION BY g.lang, k.term), 0) AS total, coalesce(sum(c.n) OVER (PARTITION BY g.lang), 0) AS lang_size
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (size + v) AS p, 1 + (1000000000::HUGEINT * (total + 1)) // (lang_size + v) AS q FROM a
), pairs AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), r AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pairs ON pairs.lang = g.lang AND pairs.source = g.source AND pairs.item = h.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM r QUALIFY part = 'pair' OR rank <= 200
"""
