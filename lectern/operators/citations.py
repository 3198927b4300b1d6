"""Citations: automatic precedence, lookups as joins, exports, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions.text import jaccard, title_words


def chosen_doi(hint: Column, embedded: Column, text: Column) -> Column:
    """The hint, else the embedded DOI, else that of an arXiv number, else the first in the text."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    raw = F.coalesce(blank(hint), blank(embedded), ids.arxiv_doi(text), ids.extract_doi(text))
    return ids.clean_doi(F.regexp_replace(raw, r"^(?i)https?://(dx\.)?doi\.org/", ""))


def chosen_title(embedded: Column, layout: Column) -> Column:
    usable = lambda c: F.when(~ids.is_junk_title(c), F.trim(c))
    return F.coalesce(usable(embedded), usable(layout))


def auto_citations(papers: DataFrame, works: DataFrame) -> DataFrame:
    """Citation of each paper (id, doi, title, authors, year), completed from a table of known works by DOI.

    A paper whose DOI is not known is looked up by its title (similarity 0.8 or more); failing that it keeps what it has,
    with the unknown author and title of the reference.
    """
    key = F.lower(F.col("doi"))
    w = works.select(F.lower("doi").alias("__doi"), F.col("doi").alias("w_doi"), F.col("title").alias("w_title"), F.col("authors").alias("w_authors"), F.col("year").alias("w_year"))
    by_doi = papers.join(w, key == F.col("__doi"), "left").drop("__doi")
    known, rest = by_doi.where("w_title is not null"), papers.join(by_doi.where("w_title is not null").select("id"), "id", "left_anti")
    pairs = similar_titles(rest.select("id", "title"), w.select(F.col("w_doi").alias("wid"), F.col("w_title").alias("wtitle")))
    similar = pairs.join(w, pairs["wid"] == w["w_doi"])
    best = similar.groupBy("id").agg(F.max(F.struct("__s", "w_doi", "w_title", "w_authors", "w_year")).alias("b")).select("id", "b.w_doi", "b.w_title", "b.w_authors", "b.w_year")
    others = rest.join(best, "id", "left")
    every = known.withColumn("source", F.lit("lookup")).unionByName(others.withColumn("source", F.when(F.col("w_title").isNotNull(), "title").otherwise("auto")))
    filled = every.select(
        "id", F.coalesce("doi", "w_doi").alias("doi"), F.coalesce("w_title", "title", F.lit("Unknown Title")).alias("title"),
        F.coalesce("w_authors", "authors", F.lit("Unknown Author")).alias("authors"), F.coalesce("w_year", "year").alias("year"), "source",
    )
    return filled.withColumn("bibtex", ids.bibtex(F.col("authors"), F.col("title"), F.col("year"), F.col("doi")))


def similar_titles(papers: DataFrame, works: DataFrame, least: float = 0.8) -> DataFrame:
    """(id, wid, __s) of titles whose word sets have a Jaccard similarity of ``least`` or more.

    Two such sets share a word among the first n - ceil(least * n) + 1 of each, rarest first, so only those words meet
    and no frequent word brings all titles together.
    """
    words = lambda df, title: df.withColumn("words", title_words(F.col(title)))
    p, w = words(papers, "title"), words(works, "wtitle")
    rare = w.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))

    def prefix(df: DataFrame, key: str) -> DataFrame:
        spread = df.select(key, F.size("words").alias("n"), F.explode("words").alias("word")).join(rare, "word", "left")
        place = F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("df", F.lit(0)), "word"))
        return spread.withColumn("k", place).where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select(key, "word")

    met = prefix(p, "id").join(prefix(w, "wid"), "word").select("id", "wid").distinct()
    scored = met.join(p.select("id", F.col("words").alias("a")), "id").join(w.select("wid", F.col("words").alias("b")), "wid")
    return scored.select("id", "wid", jaccard(F.col("a"), F.col("b")).alias("__s")).where(F.col("__s") >= least)


def validate(papers: DataFrame, citations: DataFrame, key: str, order: str) -> DataFrame:
    """Whether each asked-for paper has a citation, in the order of the question."""
    have = citations.select(F.col(key), F.lit(True).alias("__have")).distinct()
    return papers.join(have, key, "left").select(order, key, F.coalesce("__have", F.lit(False)).alias("has_citation"))


def collection_export(rows: DataFrame, collection: str, name: str, order: str, form: str = "markdown") -> DataFrame:
    """One text per collection from rows with title, cit_title, authors, year, doi, bibtex (null where nothing is cited)."""
    cited = F.col("bibtex").isNotNull()
    total, missing = F.count(F.lit(1)), F.count(F.when(~cited, 1))
    if form == "bibtex":
        pieces = F.sort_array(F.collect_list(F.when(cited, F.struct(order, F.col("bibtex").alias("line")))))
        lines = rows.groupBy(collection, name).agg(total.alias("total"), missing.alias("missing"), pieces.alias("l"))
        note = F.when(F.col("missing") > 0, F.concat(F.lit("% "), F.col("missing").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" papers had no citation")))
        body = F.nullif(F.array_join(F.transform("l", lambda x: x["line"]), "\n\n"), F.lit(""))
        return lines.select(collection, F.concat_ws("\n", note, body).alias("export"))
    year = F.coalesce(F.nullif(F.col("year"), F.lit(0)).cast("string"), F.lit(""))
    doi = F.when(F.coalesce("doi", F.lit("")) != "", F.concat(F.lit(". [doi](https://doi.org/"), "doi", F.lit(")"))).otherwise("")
    full = F.concat(F.lit("- **"), F.coalesce(F.nullif(F.col("cit_title"), F.lit("")), F.col("title")), F.lit("** — "), F.coalesce("authors", F.lit("")), F.lit(" ("), year, F.lit(")"), doi)
    line = F.when(cited, full).otherwise(F.concat(F.lit("- "), "title"))
    lines = rows.groupBy(collection, name).agg(total.alias("total"), missing.alias("missing"), F.sort_array(F.collect_list(F.struct(order, line.alias("line")))).alias("l"))
    note = F.when(F.col("missing") > 0, F.concat(F.col("missing").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" papers had no citation.\n\n"))).otherwise("")
    return lines.select(collection, F.concat(F.lit("# "), name, F.lit("\n\n"), note, F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("export"))
