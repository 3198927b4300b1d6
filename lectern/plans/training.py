"""Queries of the training log and its exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import training
from ..sources.tables import table


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with citations written into them, and four retrieved chunks each."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    reply = F.concat(F.col("text"), F.lit(" [p."), (F.col("conv_id") % 9 + 1).cast("string"), F.lit("] and [Alpha study , p. "), (F.col("turn") + 1).cast("string"), F.lit("]"))
    chunk = lambda i: F.struct(
        (F.col("conv_id") * 10 + i).alias("chunk_id"), F.lit("Alpha study of x" if i % 2 else "Beta").alias("title"), F.lit(2 * i - 1).alias("page_number"),
        F.lit(0 if i == 4 else 2 * i).alias("end_page_number"), F.lit(i < 4).alias("included_in_prompt"),
    )
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), reply.alias("reply"), F.when(F.col("conv_id") % 2 == 0, "collection").otherwise("single_pdf").alias("scope"),
        F.array(*(chunk(i) for i in (1, 2, 3, 4))).alias("retrieved"), F.col("text").alias("query_text"),
        F.array(F.col("conv_id") * 10 + 1, F.col("conv_id") * 10 + F.col("turn") % 6).alias("cited_chunk_ids"), (F.col("conv_id") % 5 != 0).alias("training_eligible"),
        F.lit("You answer from the excerpts.").alias("system_prompt"), F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("prompt_messages"),
        F.col("text").alias("assistant_reply"), F.lit("model-a").alias("llm_model"),
    )


def citation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = training.citation_events(interactions(spark, sf_dir))
    return e.select("id", "citation_rank", "title", "page", F.array_join(F.col("matched").cast("array<string>"), ",").alias("matched"), "status")


def citation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interactions(spark, sf_dir)
    return training.parse_status(rows, training.citation_events(rows)).groupBy("parse_status").agg(F.count(F.lit(1)).alias("n"))


def chunk_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interactions(spark, sf_dir)
    return training.chunk_feedback(rows, training.citation_events(rows)).select("id", "chunk_id", "retrieval_rank", "citation_rank", "was_cited")


def embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = training.embedding_pairs(training.eligible(interactions(spark, sf_dir)), anonymise=True)
    return out.select("interaction_id", "query", F.col("positive.chunk_id").alias("positive_id"), F.array_join(F.transform("negatives", lambda c: c["chunk_id"].cast("string")), ",").alias("negative_ids"))


def sft_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = training.sft_messages(training.eligible(interactions(spark, sf_dir)))
    return out.select("interaction_id", "llm_model", F.size("messages").alias("n"), F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.sha2(m["content"], 256))), ";").alias("digest"))


def eval_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = training.eval_set(training.eligible(interactions(spark, sf_dir), include_ineligible=True), anonymise=True)
    return out.select("interaction_id", "query", F.array_join(F.col("relevant_chunk_ids").cast("array<string>"), ",").alias("relevant"), F.size("all_retrieved").alias("retrieved"))


QUERIES = {f.__name__: f for f in (citation_events, citation_status, chunk_feedback, embedding_pairs, sft_messages, eval_set)}

_EVENTS = """WITH c AS (SELECT conv_id * 100 + turn AS id, conv_id, turn, text, conv_id % 2 = 0 AS coll FROM conversations WHERE role = 'assistant'),
  e AS (SELECT id, conv_id, coll, 1 AS citation_rank, 'Alpha study' AS title, (turn + 1)::INT AS page FROM c UNION ALL SELECT id, conv_id, coll, 2, NULL, (conv_id % 9 + 1)::INT FROM c),
  k AS (SELECT * FROM (VALUES (1, 'alpha'), (2, 'beta'), (3, 'alpha'), (4, 'beta')) t(i, t)),
  m AS (SELECT e.*, string_agg((conv_id * 10 + i)::VARCHAR, ',' ORDER BY i) AS matched, count(i) AS n, min(conv_id * 10 + i) AS first_id FROM e
    LEFT JOIN k ON page BETWEEN 2 * i - 1 AND CASE WHEN i = 4 THEN 7 ELSE 2 * i END AND (NOT coll OR (title IS NOT NULL AND t = 'alpha')) GROUP BY ALL),
  s AS (SELECT *, CASE n WHEN 0 THEN 'unmatched' WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM m)"""
_CITED = "(conv_id % 5 <> 0)"
SQL = {
    "citation_events": f"{_EVENTS} SELECT id, citation_rank, title, page, coalesce(matched, '') AS matched, status FROM s",
    "citation_status": f"""{_EVENTS}, p AS (SELECT id, CASE WHEN bool_or(status = 'ambiguous') THEN 'ambiguous' WHEN bool_or(status = 'unmatched') THEN 'partial' ELSE 'parsed' END AS parse_status FROM s GROUP BY id)
      SELECT parse_status, count(*) AS n FROM p GROUP BY 1""",
    "chunk_feedback": f"""{_EVENTS}, f AS (SELECT id, first_id, min(citation_rank) AS citation_rank FROM s WHERE status = 'matched' GROUP BY 1, 2)
      SELECT c.id, c.conv_id * 10 + i AS chunk_id, i AS retrieval_rank, citation_rank, citation_rank IS NOT NULL AS was_cited FROM c CROSS JOIN k LEFT JOIN f ON f.id = c.id AND f.first_id = c.conv_id * 10 + i""",
    "embedding_pairs": f"""WITH c AS (SELECT conv_id * 100 + turn AS id, conv_id, turn % 6 AS t, text AS q FROM conversations WHERE role = 'assistant' AND {_CITED}),
      p AS (SELECT DISTINCT id, conv_id, t, q, unnest([1, t]) AS i FROM c)
      SELECT id AS interaction_id, q AS query, conv_id * 10 + i AS positive_id, array_to_string(list_transform(list_filter([1, 2, 3], lambda k: k <> 1 AND k <> t), lambda k: (conv_id * 10 + k)::VARCHAR), ',') AS negative_ids
      FROM p WHERE i BETWEEN 1 AND 4""",
    "sft_messages": f"""SELECT conv_id * 100 + turn AS interaction_id, 'model-a' AS llm_model, 3 AS n,
      'system:' || sha256('You answer from the excerpts.') || ';user:' || sha256(text) || ';assistant:' || sha256(text) AS digest FROM conversations WHERE role = 'assistant' AND {_CITED}""",
    "eval_set": "SELECT conv_id * 100 + turn AS interaction_id, text AS query, (conv_id * 10 + 1) || ',' || (conv_id * 10 + turn % 6) AS relevant, 4 AS retrieved FROM conversations WHERE role = 'assistant'",
}
