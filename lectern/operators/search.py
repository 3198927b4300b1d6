"""Retrieval: cosine top-k, keyword match, weighted fusion, boost, caps, rerank order, context assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vector import cosine, vector_literal
from . import postings

SEMANTIC_WEIGHT, KEYWORD_WEIGHT = 0.7, 0.3
CONTEXT_TOKENS, LEAST_REST = 6000, 50


def vector_top_k(chunks: DataFrame, query: Sequence[float], k: int, *, key: str = "id", vector: str = "embedding", score: str = "score") -> DataFrame:
    """The k nearest chunks by cosine, ties by key: a projection and one top-k, no exchange of the table."""
    scored = chunks.where(F.col(vector).isNotNull()).withColumn(score, F.round(cosine(F.col(vector), vector_literal(query)), 6))
    return scored.where(F.col(score).isNotNull()).orderBy(F.desc(score), F.asc(key)).limit(k)


def keyword_matches(chunks: DataFrame, terms: Sequence[str], *, key: str = "id", content: str = "content", score: str = "keyword_score") -> DataFrame:
    """The chunks that hold every term (stems, see ``english.query_terms``) with their rank, from their texts, without an index."""
    found = postings.matches(postings.postings(chunks, key=key, content=content, only=terms), terms, key=key, score=score)
    return chunks.join(found, key)


def keyword_top_k(found: DataFrame, k: int, *, key: str = "id", score: str = "keyword_score") -> DataFrame:
    return found.orderBy(F.desc(score), F.asc(key)).limit(k)


def fused_score(semantic: str, keyword: str) -> Column:
    return F.round(F.coalesce(F.col(semantic), F.lit(0.0)) * SEMANTIC_WEIGHT + F.coalesce(F.col(keyword), F.lit(0.0)) * KEYWORD_WEIGHT, 6)


def hybrid_search(chunks: DataFrame, query: Sequence[float], found: DataFrame | None, k: int, *, key: str = "id", join_key: str | None = None) -> DataFrame:
    """Nearest 2k chunks and best k keyword chunks, joined in full, fused, the best k.

    ``found`` has (key, keyword_score) of the chunks that match the question, as ``PostingsIndex.matches`` gives them; those outside
    ``chunks`` fall away.  ``join_key`` other than the chunk key (a document id) keeps the fan-out of a document's chunks on both
    sides.  Without a question in words (None) only the vector side is asked; one of stop words alone matches nothing.
    """
    if found is None:
        return vector_top_k(chunks, query, k, key=key).withColumnRenamed("score", "combined_score")
    on = join_key or key
    # both sides rank narrow rows; the columns of the few chunks that are left are joined last
    ids = list(dict.fromkeys([key, on]))
    v = vector_top_k(chunks.select(*ids, "embedding"), query, 2 * k, key=key, score="semantic_score").select(*ids, "semantic_score")
    w = keyword_top_k(chunks.select(*ids).join(found, key), k, key=key).select(*(F.col(c).alias(f"kw_{c}") for c in ids), "keyword_score")
    both = v.join(w, F.col(on) == F.col(f"kw_{on}"), "full_outer")
    fused = both.select(F.coalesce(key, f"kw_{key}").alias(key), F.col(f"kw_{key}").alias("__kw"), fused_score("semantic_score", "keyword_score").alias("combined_score"))
    best = fused.orderBy(F.desc("combined_score"), F.asc(key), F.asc_nulls_last("__kw")).limit(k)
    columns = [c for c in chunks.columns if c not in ("embedding", key)]
    full = chunks.select(key, *columns).join(F.broadcast(best), key)  # k rows
    return full.orderBy(F.desc("combined_score"), F.asc(key), F.asc_nulls_last("__kw")).limit(k).select(key, *columns, "combined_score")


def best_per_document(rows: DataFrame, document: str, score: str, limit: int, *, key: str = "id") -> DataFrame:
    """First row of each document in score order, then the limit (rows already cut by a search)."""
    first = Window.partitionBy(document).orderBy(F.desc(score), F.asc(key))
    return rows.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k").orderBy(F.desc(score), F.asc(document)).limit(limit)


def cap_per_document(rows: DataFrame, document: str, score: str, most: int = 6, *, key: str = "id") -> DataFrame:
    best = Window.partitionBy(document).orderBy(F.desc(score), F.asc(key))
    return rows.withColumn("doc_rank", F.row_number().over(best)).where(F.col("doc_rank") <= most)


def proximity_boost(rows: DataFrame, page: str, current: int, score: str, k: int, *, key: str = "id") -> DataFrame:
    """Raise scores near the current page after the cut to k: times 1.1 on the page, less by distance, 1 from ten pages on."""
    boost = F.lit(1.0) + F.greatest(F.lit(0.0), F.lit(0.1) * (1 - F.abs(F.col(page) - current) / 10))
    return rows.withColumn(score, F.round(F.col(score) * boost, 6)).orderBy(F.desc(score), F.asc(key)).limit(k)


def rerank(rows: DataFrame, order: DataFrame, k: int, *, ordinal: str = "ordinal", score: str = "rerank_score") -> DataFrame:
    """Put a pool in a reranker's order: (ordinal, score) pairs from 0; ordinals outside the pool fall away."""
    return rows.join(order, ordinal).orderBy(F.desc(score), F.asc(ordinal)).limit(k)


def shortlist(hits: DataFrame, chunk: str, category: str, score: str) -> DataFrame:
    """Hits of several searches merged: each chunk with the categories that found it and its best score."""
    return hits.groupBy(chunk).agg(F.array_sort(F.collect_set(category)).alias("categories"), F.max(score).alias("best_score"))


def pages_overlap(page: Column, end_page: Column, pages: Sequence[int]) -> Column:
    if not pages:
        return F.lit(True)
    last = F.coalesce(F.nullif(end_page, F.lit(0)), page)
    return F.exists(F.array(*(F.lit(p) for p in pages)), lambda p: p.between(page, last))


def assemble_context(rows: DataFrame, group: str, rank: str, content: str, page: str, end_page: str, section: str, budget: int = CONTEXT_TOKENS) -> DataFrame:
    """Chunks of each context that fit the token budget, in rank order; the one that overflows is cut if over 50 tokens are left.

    ``rank`` is distinct within a context.  Token counts are added up without the texts, which only the chunks kept join again.
    """
    labelled = rows.withColumn("chunk_text", F.concat(tx.context_header(F.col(page), F.col(end_page), F.col(section)), F.lit("\n"), F.col(content)))
    narrow = labelled.select(group, rank, tx.token_count(F.col("chunk_text")).alias("tokens"))
    before = Window.partitionBy(group).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    run = narrow.withColumn("used", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    fits = F.col("used") + F.col("tokens") <= budget
    cut = ~fits & (F.col("used") < budget) & (budget - F.col("used") > LEAST_REST)
    # the first chunk that does not fit ends the context
    earlier = run.withColumn("overflow", (~fits).cast("int")).withColumn("overflows", F.coalesce(F.sum("overflow").over(before), F.lit(0)))
    kept = earlier.where((F.col("overflows") == 0) & (fits | cut)).select(F.col(group).alias("__group"), F.col(rank).alias("__rank"), "tokens", "used")
    texts = labelled.join(kept, F.col(group).eqNullSafe(F.col("__group")) & (F.col(rank) == F.col("__rank"))).drop("__group", "__rank")
    return texts.withColumn("piece", F.when(fits, F.col("chunk_text")).otherwise(tx.truncate_tokens(F.col("chunk_text"), F.lit(budget) - F.col("used"))))
