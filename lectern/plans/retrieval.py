"""Queries of retrieval: scopes, fusion, boost, caps, rerank order, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import english
from ..functions import text as tx
from ..functions.vector import mean_vectors
from ..operators import library, search
from ..operators.neighbours import CellIndex
from ..operators.postings import PostingsIndex
from ..sources.scratch import new_folder
from ..sources.tables import scoped, table
from . import model

WITH = "WITH " + model.SQL


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_top_k(model.vectors(spark, sf_dir), model.query_vector(spark, sf_dir), 10).select("id", "pdf_id", "page_number", "score")


def vector_topk_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoped(model.vectors(spark, sf_dir), pdf_id=3)
    return search.vector_top_k(rows, model.query_vector(spark, sf_dir), 10).select("id", "pdf_id", "score")


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.hybrid_search(model.chunks(spark, sf_dir), model.query_vector(spark, sf_dir), model.text_index(spark, sf_dir).matches(model.TERMS), 10)
    return out.select("id", "pdf_id", "page_number", "end_page_number", "combined_score")


def hybrid_stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question of stop words alone matches no text, so the vector side alone is weighted."""
    out = search.hybrid_search(model.chunks(spark, sf_dir), model.query_vector(spark, sf_dir), model.text_index(spark, sf_dir).matches(english.query_terms("What is it that they were")), 10)
    return out.select("id", "pdf_id", "combined_score")


def fulltext_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks that hold the question's words in any form, with their rank."""
    return search.keyword_matches(model.chunks(spark, sf_dir), model.TERMS).select("id", "pdf_id", "keyword_score")


def fulltext_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored postings after a third of the chunks were replaced and a few forgotten, asked for one word in any form."""
    rows = model.chunks(spark, sf_dir).select("id", "content")
    index = PostingsIndex(spark, new_folder(spark, "changed_index"), buckets=8)
    index.write(rows.withColumn("content", F.when(F.col("id") % 3 == 0, F.lit("old things")).otherwise(F.col("content"))), 0)
    index.write(rows.where("id % 3 = 0").withColumn("content", F.when(F.col("id") % 9 != 0, F.col("content"))), 1)
    return index.matches(english.query_terms("things"))


def hybrid_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the documents of one collection, through the bridge table of its members."""
    members = table(spark, sf_dir, "nation").where("n_nationkey < 10 and n_regionkey = 1").select(F.col("n_nationkey").alias("pdf_id"), F.col("n_name").alias("pdf_title"))
    rows = model.chunks(spark, sf_dir).join(members, "pdf_id")
    out = search.hybrid_search(rows, model.query_vector(spark, sf_dir), model.text_index(spark, sf_dir).matches(model.TERMS), 8)
    return out.select("id", "pdf_id", "pdf_title", "combined_score")


def library_best_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library scope: the two sides meet on the document, fan out, are cut to the limit and only then reduced."""
    fused = search.hybrid_search(model.chunks(spark, sf_dir), model.query_vector(spark, sf_dir), model.text_index(spark, sf_dir).matches(model.TERMS), 10, join_key="pdf_id")
    best = search.best_per_document(fused, "pdf_id", "combined_score", 10)
    return best.select("pdf_id", "id", F.substring("content", 1, 300).alias("snippet"), "combined_score")


def _cells(spark: SparkSession, sf_dir: str) -> CellIndex:
    return CellIndex(spark, new_folder(spark, "cells")).build(model.vectors(spark, sf_dir))


def _questions(spark: SparkSession, sf_dir: str, rest: int, of: int = 50) -> DataFrame:
    return model.vectors(spark, sf_dir).where(F.col("id") % of == rest).select(F.col("id").alias("query_id"), F.col("embedding").cast("array<double>").alias("unit"))


def neighbours_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest chunks of many questions at once, through the cells, with every cell read that may hold one."""
    return _cells(spark, sf_dir).search(_questions(spark, sf_dir, 0), 10).select("query_id", "id", "score", "rank")


def neighbours_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells probed as measured on some questions, and the recall of others' ten nearest chunks at that number."""
    index = _cells(spark, sf_dir)
    probes = index.probes_for(_questions(spark, sf_dir, 1, of=10), 10, least=0.98)
    asked = _questions(spark, sf_dir, 0)
    exact, got = index.search(asked, 10), index.search(asked, 10, probes)
    hits = exact.select("query_id", "id").join(got.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.agg(F.countDistinct("query_id").alias("questions"), (F.count("hit") / F.count(F.lit(1)) >= 0.95).alias("enough"))


def library_vector_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector-only library search: three times the limit, then the best chunk of each document."""
    top = search.vector_top_k(model.vectors(spark, sf_dir), model.query_vector(spark, sf_dir), 15)
    return search.best_per_document(top, "pdf_id", "score", 5).select("pdf_id", "page_number", "score")


def chunk_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoped(model.chunks(spark, sf_dir), chunk_type=["table"])
    return search.vector_top_k(rows, model.query_vector(spark, sf_dir), 10).select("id", "chunk_type", "score")


def proximity_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = search.vector_top_k(model.vectors(spark, sf_dir), model.query_vector(spark, sf_dir), 10)
    return search.proximity_boost(top, "page_number", 5, "score", 10).select("id", "page_number", "score")


def per_doc_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = search.vector_top_k(model.vectors(spark, sf_dir), model.query_vector(spark, sf_dir), 50)
    return search.cap_per_document(top, "pdf_id", "score", 6).select("pdf_id", "id", "score", "doc_rank")


def rerank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of 50 in the order a reranker gives; here its scores are a fixed function of the chunk."""
    from pyspark.sql import Window

    pool = search.vector_top_k(model.vectors(spark, sf_dir), model.query_vector(spark, sf_dir), 50)
    pool = pool.withColumn("ordinal", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1)
    scores = spark.range(0, 60).select(F.col("id").cast("int").alias("ordinal"), ((F.col("id") * 37) % 101).alias("rerank_score"))
    return search.rerank(pool, scores, 8).select("id", "ordinal", "rerank_score")


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("source", "doc_id", F.col("text").alias("content"), (F.col("doc_id") % 30 + 1).cast("int").alias("page"), (F.col("doc_id") % 30 + 1 + F.col("doc_id") % 2).cast("int").alias("end_page"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("section"))
    kept = search.assemble_context(rows, "source", "doc_id", "content", "page", "end_page", "section")
    return kept.select("source", "doc_id", "tokens", "used", F.length("piece").alias("piece_chars"), F.substring("piece", 1, 20).alias("piece_head"))


def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.near_duplicate_pairs(model.vectors(spark, sf_dir), "pdf_id", "id", "embedding", 0.35, 20)


def mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = mean_vectors(model.vectors(spark, sf_dir), "pdf_id", "embedding")
    return means.select("pdf_id", F.posexplode("mean_vector").alias("place", "value")).select("pdf_id", "place", F.round("value", 6).alias("value"))


def shortlist_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunks for each of three category questions, on given pages, merged by chunk."""
    rows = model.vectors(spark, sf_dir)
    rows = rows.where(search.pages_overlap(F.col("page_number"), F.col("end_page_number"), [1, 2, 3, 4, 5, 6]))
    hits = None
    for category, vec_id in (("claims", 0), ("methods", 1), ("results", 2)):
        top = search.vector_top_k(rows, model.query_vector(spark, sf_dir, vec_id), 15).select("id", F.lit(category).alias("category"), "score")
        hits = top if hits is None else hits.unionByName(top)
    out = search.shortlist(hits, "id", "category", "score")
    return out.select("id", F.array_join("categories", ",").alias("categories"), "best_score")


def snippet_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.substring("text", 1, 200).alias("snippet"), F.substring("text", 1, 300).alias("preview"))


def collection_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection scope: the top chunks with their labels, without dedup or budget, in one text."""
    top = search.vector_top_k(model.chunks(spark, sf_dir), model.query_vector(spark, sf_dir), 8)
    parts = top.select("id", "score", F.concat(tx.context_header(F.col("page_number"), F.col("end_page_number"), F.lit(None).cast("string")), F.lit("\n"), "content").alias("part"))
    listed = parts.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "part"))).alias("parts"))
    return listed.select(F.sha2(F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n---\n\n"), 256).alias("context_sha256"))


QUERIES = {f.__name__: f for f in (vector_topk, vector_topk_by_label, hybrid_search, hybrid_stop_words, fulltext_match, fulltext_index, hybrid_collection, library_best_per_doc, neighbours_exact, neighbours_recall, library_vector_best, chunk_type_filter, proximity_boost, per_doc_cap, rerank_order, context_budget, near_duplicate_pairs, mean_vector, shortlist_merge, snippet_projection, collection_context)}

_TOP = "ORDER BY score DESC, id LIMIT"
_FUSED = "round(coalesce(v.score, 0) * 0.7 + coalesce(k.kw, 0) * 0.3, 6)"
SQL = {
    "vector_topk": f"{WITH} SELECT id, pdf_id, page_number, score FROM vectors {_TOP} 10",
    "vector_topk_by_label": f"{WITH} SELECT id, pdf_id, score FROM vectors WHERE pdf_id = 3 {_TOP} 10",
    "hybrid_search": f"""{WITH}, v AS (SELECT * FROM words {_TOP} 20), k AS (SELECT * FROM words WHERE kw IS NOT NULL ORDER BY kw DESC, id LIMIT 10)
      SELECT coalesce(v.id, k.id) AS id, coalesce(v.pdf_id, k.pdf_id) AS pdf_id, coalesce(v.page_number, k.page_number) AS page_number,
        coalesce(v.end_page_number, k.end_page_number) AS end_page_number, {_FUSED} AS combined_score
      FROM v FULL OUTER JOIN k ON v.id = k.id ORDER BY combined_score DESC, 1 LIMIT 10""",
    "hybrid_stop_words": f"{WITH} SELECT id, pdf_id, round(score * 0.7, 6) AS combined_score FROM (SELECT * FROM chunks {_TOP} 20) ORDER BY 3 DESC, id LIMIT 10",
    "fulltext_match": f"{WITH} SELECT id, pdf_id, kw AS keyword_score FROM words WHERE kw IS NOT NULL",
    "fulltext_index": f"""{WITH} SELECT id, round(0.1 / 1.64493406685 * list_sum(list_transform(generate_series(1, len(one)), lambda i: 1.0::DOUBLE / (i * i))), 6) AS keyword_score
      FROM places WHERE len(one) > 0 AND id % 9 <> 0""",
    "hybrid_collection": f"""{WITH}, c AS (SELECT words.*, n_name AS pdf_title FROM words JOIN nation ON n_nationkey = pdf_id WHERE n_nationkey < 10 AND n_regionkey = 1),
      v AS (SELECT * FROM c {_TOP} 16), k AS (SELECT * FROM c WHERE kw IS NOT NULL ORDER BY kw DESC, id LIMIT 8)
      SELECT coalesce(v.id, k.id) AS id, coalesce(v.pdf_id, k.pdf_id) AS pdf_id, coalesce(v.pdf_title, k.pdf_title) AS pdf_title, {_FUSED} AS combined_score
      FROM v FULL OUTER JOIN k ON v.id = k.id ORDER BY combined_score DESC, 1 LIMIT 8""",
    "library_best_per_doc": f"""{WITH}, v AS (SELECT * FROM words {_TOP} 20), k AS (SELECT * FROM words WHERE kw IS NOT NULL ORDER BY kw DESC, id LIMIT 10),
      f AS (SELECT coalesce(v.pdf_id, k.pdf_id) AS pdf_id, coalesce(v.id, k.id) AS id, coalesce(v.content, k.content) AS content, {_FUSED} AS combined_score, k.id AS kid
        FROM v FULL OUTER JOIN k ON v.pdf_id = k.pdf_id ORDER BY combined_score DESC, 2, kid NULLS LAST LIMIT 10),
      r AS (SELECT *, row_number() OVER (PARTITION BY pdf_id ORDER BY combined_score DESC, id) AS rn FROM f)
      SELECT pdf_id, id, substr(content, 1, 300) AS snippet, combined_score FROM r WHERE rn = 1 ORDER BY combined_score DESC, pdf_id LIMIT 10""",
    "neighbours_exact": """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
      FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0)
      SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s QUALIFY rank <= 10""",
    "neighbours_recall": "SELECT count(*) AS questions, true AS enough FROM embeddings WHERE vec_id % 50 = 0",
    "library_vector_best": f"""{WITH}, t AS (SELECT * FROM vectors {_TOP} 15), r AS (SELECT *, row_number() OVER (PARTITION BY pdf_id ORDER BY score DESC, id) AS rn FROM t)
      SELECT pdf_id, page_number, score FROM r WHERE rn = 1 ORDER BY score DESC, pdf_id LIMIT 5""",
    "chunk_type_filter": f"{WITH} SELECT id, chunk_type, score FROM chunks WHERE chunk_type IN ('table') {_TOP} 10",
    "proximity_boost": f"""{WITH}, t AS (SELECT * FROM vectors {_TOP} 10)
      SELECT id, page_number, round(score * (1 + greatest(0, 0.1::DOUBLE * (1 - abs(page_number - 5) / 10))), 6) AS score FROM t""",
    "per_doc_cap": f"""{WITH}, t AS (SELECT * FROM vectors {_TOP} 50), r AS (SELECT *, row_number() OVER (PARTITION BY pdf_id ORDER BY score DESC, id)::INT AS doc_rank FROM t)
      SELECT pdf_id, id, score, doc_rank FROM r WHERE doc_rank <= 6""",
    "rerank_order": f"""{WITH}, t AS (SELECT *, (row_number() OVER (ORDER BY score DESC, id) - 1)::INT AS ordinal FROM (SELECT * FROM vectors {_TOP} 50))
      SELECT id, ordinal, (ordinal * 37) % 101 AS rerank_score FROM t ORDER BY rerank_score DESC, ordinal LIMIT 8""",
    "context_budget": """WITH b AS (
        SELECT source, doc_id, '[' || CASE WHEN doc_id % 2 > 0 THEN 'Pages ' || (doc_id % 30 + 1) || '-' || (doc_id % 30 + 1 + doc_id % 2) ELSE 'Page ' || (doc_id % 30 + 1) END
          || CASE WHEN doc_id % 3 = 0 THEN ' · ' || lang ELSE '' END || ']' || chr(10) || text AS t FROM documents),
      r AS (SELECT *, length(t) // 4 AS tokens, coalesce(sum(length(t) // 4) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM b),
      o AS (SELECT *, coalesce(sum((used + tokens > 6000)::INT) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_before FROM r),
      p AS (SELECT *, CASE WHEN used + tokens <= 6000 THEN t ELSE substr(t, 1, (6000 - used) * 4) END AS piece FROM o WHERE over_before = 0 AND (used + tokens <= 6000 OR 6000 - used > 50))
      SELECT source, doc_id, tokens, used, length(piece) AS piece_chars, substr(piece, 1, 20) AS piece_head FROM p""",
    "near_duplicate_pairs": f"""{WITH} SELECT a.pdf_id, a.id AS id_a, b.id AS id_b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity
      FROM vectors a JOIN vectors b ON a.pdf_id = b.pdf_id AND a.id < b.id WHERE round(list_cosine_similarity(a.v, b.v), 6) >= 0.35 ORDER BY similarity DESC, id_a, id_b LIMIT 20""",
    "mean_vector": """SELECT label AS pdf_id, (i - 1)::INT AS place, round(avg(embedding[i]::DOUBLE), 6) AS value
      FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY label, i""",
    "shortlist_merge": """WITH h AS (
        SELECT e.vec_id AS id, c.category, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
        FROM embeddings e, (VALUES ('claims', 0), ('methods', 1), ('results', 2)) c(category, qid) JOIN embeddings q ON q.vec_id = c.qid
        WHERE e.vec_id % 20 + 1 <= 6),
      r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, id) AS rn FROM h)
      SELECT id, string_agg(category, ',' ORDER BY category) AS categories, max(score) AS best_score FROM r WHERE rn <= 15 GROUP BY id""",
    "snippet_projection": "SELECT doc_id, substr(text, 1, 200) AS snippet, substr(text, 1, 300) AS preview FROM documents",
    "collection_context": f"""{WITH}, t AS (SELECT * FROM chunks {_TOP} 8)
      SELECT sha256(string_agg('[' || CASE WHEN end_page_number > page_number THEN 'Pages ' || page_number || '-' || end_page_number ELSE 'Page ' || page_number END || ']' || chr(10) || content,
        chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY score DESC, id)) AS context_sha256 FROM t""",
}
