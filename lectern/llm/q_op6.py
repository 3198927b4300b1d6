"""Query and SQL of operator 6."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exact_dedup import exact_dedup


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the rows, by a hash of the id, stand for the snapshot already held; the others are the new batch."""
    incoming = F.crc32(F.col("doc_id").cast("string")) % 2 == 1
    return exact_dedup(table(spark, sf_dir, "documents"), incoming)


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256)::BIGINT AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""
