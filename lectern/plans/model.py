"""The reference's model on the driver's tables, in Spark and in SQL.

chunk = embeddings row with the text of the document of the same number: id, pdf_id (label), collection (label mod 3),
page_number, end_page_number, chunk_type, content, embedding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.english import query_terms
from ..operators.postings import PostingsIndex
from ..sources.scratch import exists, new_folder
from ..sources.tables import table

QUERY_ID = 0
QUESTION = "The thinging of the nd"
TERMS = query_terms(QUESTION)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    page = (F.col("vec_id") % 20 + 1).cast("int")
    return e.join(d.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id").select(
        F.col("vec_id").alias("id"),
        F.col("label").alias("pdf_id"),
        (F.col("label") % 3).alias("collection"),
        page.alias("page_number"),
        (page + F.col("vec_id") % 3).cast("int").alias("end_page_number"),
        F.when(F.col("vec_id") % 5 == 0, "table").otherwise("paragraph").alias("chunk_type"),
        F.col("text").alias("content"),
        "embedding",
    )


_INDEXES: dict[tuple[str, str], PostingsIndex] = {}


def text_index(spark: SparkSession, sf_dir: str) -> PostingsIndex:
    """The stored postings of the chunks' texts: built by the first question of a session, read by all while they are there."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _INDEXES or not exists(spark, _INDEXES[at].folder):
        rows = chunks(spark, sf_dir).select("id", "content")
        _INDEXES[at] = PostingsIndex(spark, new_folder(spark, "text_index"), buckets=16).write(rows, 0)
    return _INDEXES[at]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("pdf_id"), (F.col("vec_id") % 20 + 1).cast("int").alias("page_number"), (F.col("vec_id") % 20 + 1 + F.col("vec_id") % 3).cast("int").alias("end_page_number"), "embedding")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = QUERY_ID) -> list[float]:
    """The question's embedding: one row, as a service would hand it in."""
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row["embedding"])


#: The question's two terms, by the words that have their stems.  A pair of places at distance d weighs 0.1 * sqrt(w(d)).
_THING, _ND = "regexp_matches(t, '^thing(s|es|ed|ly|ing|ingly|edly|lyed|lying)?$')", "t = 'nd'"
_WEIGHT = "0.1 * sqrt(CASE WHEN abs(x - y) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(x - y) / 1.5 - 2)) END)"
SQL = f"""
q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = {QUERY_ID}),
vectors AS (
  SELECT vec_id AS id, label AS pdf_id, (vec_id % 20 + 1)::INT AS page_number, (vec_id % 20 + 1 + vec_id % 3)::INT AS end_page_number,
    round(list_cosine_similarity(embedding::DOUBLE[], qv), 6) AS score, embedding::DOUBLE[] AS v
  FROM embeddings, q
),
chunks AS (
  SELECT id, pdf_id, pdf_id % 3 AS collection, page_number, end_page_number, CASE WHEN id % 5 = 0 THEN 'table' ELSE 'paragraph' END AS chunk_type,
    text AS content, score, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS toks
  FROM vectors JOIN documents ON doc_id = id
),
places AS (
  SELECT *, list_filter(generate_series(1, len(toks)), lambda i: list_contains(things, toks[i])) AS one, list_filter(generate_series(1, len(toks)), lambda i: toks[i] = 'nd') AS other
  FROM (SELECT *, list_filter(toks, lambda t: {_THING}) AS things FROM chunks)
),
ranks AS (
  SELECT id, round(1 - exp(sum(ln(1 - {_WEIGHT}))), 6) AS kw
  FROM (SELECT id, x, unnest(other) AS y FROM (SELECT id, unnest(one) AS x, other FROM places)) GROUP BY id
),
words AS (
  SELECT chunks.*, kw FROM chunks LEFT JOIN ranks USING (id)
)
"""
