"""Query and SQL of operator 5."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .licenses import COVERS, RULES, SENTENCES, scan_licenses


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _rule(name: str) -> str:
    in_order = lambda rule: r"\|" + r"\|(.*\|)?".join(i.replace(".", "\\.") for i in rule) + r"\|"
    return "(" + " OR ".join(f"regexp_matches(seq, '{in_order(r)}')" for r in RULES[name]) + ")"


def _mark(name: str) -> str:
    covering = [f" AND NOT {_rule(k)}" for k, v in COVERS.items() if v == name]
    return f"CASE WHEN {_rule(name)}{''.join(covering)} THEN '{name}' END"


SQL = rf"""
WITH known(sentence, id) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in SENTENCES.items())}),
parts AS (
  SELECT doc_id, string_split(regexp_replace(replace(lower(coalesce(text, '')), 'spdx-license-identifier:', 'spdx-license-identifier'), '([.!?;:])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)) AS ps FROM documents
), flat AS (
  SELECT doc_id, unnest(ps) AS p, unnest(generate_series(1, len(ps)::BIGINT)) AS k FROM parts
), ids AS (
  SELECT doc_id, string_agg(id, ',' ORDER BY k) AS ids, count(*) AS n FROM flat JOIN known ON sentence = trim(regexp_replace(p, '[^a-z0-9]+', ' ', 'g')) GROUP BY doc_id
), seqs AS (
  SELECT doc_id, coalesce(ids, '') AS sentence_ids, coalesce(n, 0)::BIGINT AS n_sentences, '|' || replace(coalesce(ids, ''), ',', '|') || '|' AS seq FROM documents LEFT JOIN ids USING (doc_id)
)
SELECT doc_id, concat_ws(',', {", ".join(_mark(n) for n in sorted(RULES))}) AS licenses, n_sentences, sentence_ids FROM seqs
"""
