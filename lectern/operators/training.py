"""Training log: citations of a reply matched to retrieved chunks, feedback rows, three export forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import title_matches

# fixed values: the two citation forms
WITH_TITLE = r"(?i)\[([^\[\],]+?)[ \t]*,[ \t]*p\.[ \t]*([0-9]+)\]"
PAGE_ONLY = r"(?i)\[p\.[ \t]*([0-9]+)\]"


def citations(reply: Column) -> Column:
    """Cited (raw, title, page) of a reply: the form with a title first, then the form with a page alone.

    The two cannot overlap: a title holds no bracket and the short form no comma.
    """
    titled = F.transform(F.regexp_extract_all(reply, F.lit(WITH_TITLE), 0), lambda r: F.struct(r.alias("raw"), F.trim(F.regexp_extract(r, WITH_TITLE, 1)).alias("title"), F.regexp_extract(r, WITH_TITLE, 2).cast("int").alias("page")))
    plain = F.transform(F.regexp_extract_all(reply, F.lit(PAGE_ONLY), 0), lambda r: F.struct(r.alias("raw"), F.lit(None).cast("string").alias("title"), F.regexp_extract(r, PAGE_ONLY, 1).cast("int").alias("page")))
    return F.concat(titled, plain)


def citation_events(interactions: DataFrame) -> DataFrame:
    """One row per citation: rank, raw, title, page, matched chunk ids and status.

    ``interactions`` has id, reply, scope and retrieved (array of chunk_id, title, page_number, end_page_number).  In
    collection scope the cited title must match the chunk's; a chunk matches on the page it spans.
    """
    rows = interactions.select("id", "scope", "retrieved", F.posexplode(citations(F.col("reply"))).alias("k", "c"))

    def cited(chunk: Column) -> Column:
        last = F.coalesce(F.nullif(chunk["end_page_number"], F.lit(0)), chunk["page_number"])
        on_page = chunk["chunk_id"].isNotNull() & F.col("c.page").between(chunk["page_number"], last)
        return on_page & ((F.col("scope") != "collection") | title_matches(F.col("c.title"), chunk["title"]))

    matched = F.transform(F.filter("retrieved", cited), lambda x: x["chunk_id"])
    status = F.when(F.size("matched") == 1, "matched").when(F.size("matched") > 1, "ambiguous").otherwise("unmatched")
    return rows.withColumn("matched", matched).select("id", (F.col("k") + 1).alias("citation_rank"), "c.raw", "c.title", "c.page", "matched", status.alias("status"))


def parse_status(interactions: DataFrame, events: DataFrame) -> DataFrame:
    counts = events.groupBy("id").agg(F.max((F.col("status") == "ambiguous").cast("int")).alias("a"), F.max((F.col("status") == "unmatched").cast("int")).alias("u"))
    named = F.when(F.col("a").isNull(), "no_citations").when(F.col("a") == 1, "ambiguous").when(F.col("u") == 1, "partial").otherwise("parsed")
    return interactions.select("id").join(counts, "id", "left").select("id", named.alias("parse_status"))


def chunk_feedback(interactions: DataFrame, events: DataFrame) -> DataFrame:
    """Each retrieved chunk with its rank, whether it was cited without doubt, and the rank of its first such citation."""
    chunks = interactions.select("id", F.posexplode("retrieved").alias("k", "chunk")).select("id", (F.col("k") + 1).alias("retrieval_rank"), "chunk.chunk_id")
    first = events.where("status = 'matched'").groupBy("id", F.get("matched", F.lit(0)).alias("chunk_id")).agg(F.min("citation_rank").alias("citation_rank"))
    return chunks.join(first, ["id", "chunk_id"], "left").withColumn("was_cited", F.col("citation_rank").isNotNull())


def _scrubbed(chunk: Column, anonymise: bool) -> Column:
    return chunk.dropFields("title") if anonymise else chunk


def embedding_pairs(interactions: DataFrame, anonymise: bool = False) -> DataFrame:
    """A record per cited chunk: query, positive, and all chunks of the prompt that were not cited."""
    negative = F.filter("retrieved", lambda c: c["included_in_prompt"] & ~F.array_contains("cited_chunk_ids", c["chunk_id"]))
    rows = interactions.withColumn("negatives", F.transform(negative, lambda c: _scrubbed(c, anonymise)))
    cited = rows.select("id", "query_text", "retrieved", "negatives", F.explode(F.array_distinct("cited_chunk_ids")).alias("cited"))
    positive = F.get(F.filter("retrieved", lambda c: c["chunk_id"] == F.col("cited")), F.lit(0))
    return cited.withColumn("positive", positive).where("positive is not null").select(F.col("query_text").alias("query"), _scrubbed(F.col("positive"), anonymise).alias("positive"), "negatives", F.col("id").alias("interaction_id"))


def sft_messages(interactions: DataFrame) -> DataFrame:
    """System prompt, prompt messages and reply as one list of messages."""

    def message(role: str, content: str) -> Column:
        return F.array(F.struct(F.lit(role).alias("role"), F.col(content).alias("content")))

    messages = F.concat(message("system", "system_prompt"), F.col("prompt_messages"), message("assistant", "assistant_reply"))
    return interactions.select(messages.alias("messages"), F.col("id").alias("interaction_id"), "llm_model")


def eval_set(interactions: DataFrame, anonymise: bool = False) -> DataFrame:
    return interactions.select(F.col("query_text").alias("query"), F.col("cited_chunk_ids").alias("relevant_chunk_ids"), F.transform("retrieved", lambda c: _scrubbed(c, anonymise)).alias("all_retrieved"), F.col("id").alias("interaction_id"))


def eligible(interactions: DataFrame, include_ineligible: bool = False) -> DataFrame:
    return interactions if include_ineligible else interactions.where("training_eligible is true")
