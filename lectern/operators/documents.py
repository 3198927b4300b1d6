"""Extracted text of whole documents: page markers, truncation, layout titles, source texts for summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARKER = r"--- PAGE ([0-9]+) ---"


def pages_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page_number, content) of a text with page markers; what stands before the first marker has no page."""
    parts = F.regexp_extract_all(text, F.lit(MARKER), 1)
    bodies = F.split(F.col(text), r"--- PAGE [0-9]+ ---")
    zipped = docs.select(key, F.posexplode(F.arrays_zip(parts.alias("p"), F.slice(bodies, F.lit(2), F.size(bodies)).alias("b"))).alias("k", "z"))
    return zipped.select(key, F.col("z.p").cast("int").alias("page_number"), F.trim(F.regexp_replace("z.b", r"^[\r\n]+|[\r\n]+$", "")).alias("content"))


def truncate_at_page(text: Column, limit: int) -> Column:
    """struct(text, note): the whole pages that fit the limit; a text without a page that fits is cut by characters."""
    # a page fits if the next marker begins by the limit; the text is cut before that marker
    kept = F.regexp_extract(F.substring(text, 1, limit + 40), rf"(?s)^(.{{0,{limit}}})--- PAGE [0-9]+ ---", 1)
    numbers = F.regexp_extract_all(kept, F.lit(MARKER), F.lit(1))
    usable = (F.length(kept) > 0) & (F.size(numbers) > 0)
    cut = F.struct(F.substring(text, 1, limit).alias("text"), F.lit(f"partial (truncated at {limit} chars)").alias("note"))
    paged = F.struct(F.regexp_replace(kept, r"[ \t\r\n]+$", "").alias("text"), F.concat(F.lit("1-"), F.element_at(numbers, F.lit(-1))).alias("note"))
    whole = F.struct(text.alias("text"), F.lit("all").alias("note"))
    return F.when(F.length(text) <= limit, whole).when(usable, paged).otherwise(cut)


def layout_titles(spans: DataFrame, key: str, order: str, top: float = 0.6) -> DataFrame:
    """Title by layout: spans (text, size, y, page_height) in the top of the first page within half a point of its largest size."""
    upper = spans.where(F.col("y") <= F.col("page_height") * top)
    largest = F.max("size").over(Window.partitionBy(key))
    near = upper.withColumn("__max", largest).where(F.col("size") >= F.col("__max") - 0.5)
    joined = near.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "text"))).alias("s")).select(key, F.trim(F.array_join(F.transform("s", lambda x: x["text"]), " ")).alias("title"))
    return joined.where(F.length("title").between(10, 300))


def first_chunks(chunks: DataFrame, key: str, n: int, limit: int, name: str) -> DataFrame:
    """The first n chunks of each document joined by blanks, cut to ``limit`` characters."""
    first = Window.partitionBy(key).orderBy("chunk_index")
    kept = chunks.withColumn("__k", F.row_number().over(first)).where(F.col("__k") <= n)
    return kept.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("c")).select(key, F.substring(F.array_join(F.transform("c", lambda x: x["content"]), " "), 1, limit).alias(name))


def summary_sources(chunks: DataFrame, key: str) -> DataFrame:
    """What a summary is written from: abstract chunks, else the first three; and the conclusion where there is one."""
    every = first_chunks(chunks, key, 3, 3000, "opening")
    abstract = first_chunks(chunks.where(F.lower("section_title") == "abstract"), key, 3, 3000, "abstract")
    conclusion = first_chunks(chunks.where(F.contains(F.lower("section_title"), F.lit("conclusion"))), key, 2, 2500, "conclusion")
    joined = every.join(abstract, key, "left").join(conclusion, key, "left")
    ending = F.when(F.coalesce("conclusion", F.lit("")) != "", F.concat(F.lit("\n\n[Conclusion]\n"), "conclusion")).otherwise("")
    return joined.select(key, F.concat(F.coalesce("abstract", "opening"), ending).alias("source_text"))


def paper_bundle(papers: DataFrame, group: str, most_chars: int = 1200, most_papers: int = 20) -> DataFrame:
    """Numbered blocks of a collection's papers (position, title, year, tldr, method, result, key_claims) as one text."""
    line = Window.partitionBy(group).orderBy("position")
    numbered = papers.withColumn("__n", F.row_number().over(line)).where(F.col("__n") <= most_papers)
    year = F.when(F.coalesce("year", F.lit(0)) != 0, F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")"))).otherwise("")
    claims = F.array_join(F.slice(F.coalesce("key_claims", F.array().cast("array<string>")), 1, 5), "; ")
    blank = lambda c: F.coalesce(c, F.lit(""))
    block = F.concat(F.lit("["), F.col("__n").cast("string"), F.lit("] "), "title", year, F.lit("\nTL;DR: "), blank("tldr"), F.lit("\nMethod: "), blank("method"), F.lit("\nResult: "), blank("result"), F.lit("\nKey claims: "), claims)
    blocks = numbered.select(group, "__n", F.substring(block, 1, most_chars).alias("b"))
    return blocks.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("__n", "b"))).alias("l")).select(group, F.array_join(F.transform("l", lambda x: x["b"]), "\n\n").alias("bundle"))


def extraction_quality(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """The columns ``keep`` with score, is_usable and n_warnings of an extracted text: letters, line lengths, repeated words.

    Each step is a projection of its own over columns that the one before it made, so that every pattern is run once a text.
    """
    edge = r"^[ \t\r\n]+|[ \t\r\n]+$"
    bare = docs.select(*keep, F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("--- PAGE "), F.lit("")), edge, "").alias("bare"))
    clean = bare.select(*keep, F.regexp_replace(F.regexp_replace("bare", r"[0-9]+ ---", ""), edge, "").alias("clean"))
    # a clean text begins and ends with letters, so its blank lines are breaks followed by another break
    parts = clean.select(
        *keep,
        F.length("clean").alias("n"),
        F.length(F.regexp_replace("clean", r"[^\p{L} \t\r\n]", "")).alias("letters"),
        F.regexp_replace("clean", r"\n[ \t\r]*(?=\n)", "").alias("lines"),
        F.split(F.lower("clean"), r"[ \t\r\n]+").alias("words"),
    )
    counted = parts.select(
        *keep,
        "n",
        F.try_divide("letters", "n").alias("ratio"),
        F.length("lines").alias("held"),
        (F.length("lines") - F.length(F.replace("lines", F.lit("\n"), F.lit("")))).alias("breaks"),
        F.size("words").alias("n_words"),
        F.size(F.array_distinct("words")).alias("n_unique"),
    )
    short = F.when(F.col("n") > 0, (F.col("held") - F.col("breaks")) / (F.col("breaks") + 1) < 30)
    warnings = (F.col("ratio") < 0.5).cast("int") + short.cast("int") + ((F.col("n_words") > 50) & (F.col("n_unique") / F.col("n_words") < 0.2)).cast("int")
    judged = counted.select(*keep, "n", "ratio", warnings.alias("warnings"))
    score = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("warnings") * 0.2 - F.when(F.col("ratio") < 0.6, 0.3).otherwise(0.0))
    scored = judged.select(*keep, F.round(F.when(F.col("n") < 100, 0.0).otherwise(score), 6).alias("score"), F.when(F.col("n") < 100, 1).otherwise(F.col("warnings")).alias("n_warnings"))
    return scored.select(*keep, "score", (F.col("score") >= 0.4).alias("is_usable"), "n_warnings")
