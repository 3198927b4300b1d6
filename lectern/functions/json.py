"""JSON expressions that tolerate what language models return."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*[ \t]*\n?", ""), r"\n?```$", ""))


def tolerant_json(text: Column, schema: str) -> Column:
    """Parse after stripping fences; bare line breaks, which models leave inside strings, count as blanks.

    What is no JSON at all gives a struct of nulls, or null for an array or map.
    """
    return F.from_json(F.regexp_replace(strip_fences(text), r"[\r\n]+", " "), schema)


def clean_strings(items: Column, most: int) -> Column:
    """The first ``most`` strings that are not blank, trimmed."""
    return F.slice(F.filter(F.transform(items, lambda s: F.trim(s)), lambda s: s.isNotNull() & (s != "")), 1, most)


def index_list(items: Column, n: Column) -> Column:
    """Whole numbers from 1 to n of a list of strings, each once, in order."""
    numbers = F.transform(items, lambda s: s.try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda i: i.isNotNull() & (i >= 1) & (i <= n)))


def error_message(payload: Column) -> Column:
    return F.get_json_object(payload, "$.error")


def highlights(text: Column) -> Column:
    """Array of (text, page, category, reason) with defaults for what is missing."""
    items = tolerant_json(text, "array<struct<text:string,page:int,category:string,reason:string>>")
    return F.transform(items, lambda h: F.struct(F.coalesce(h["text"], F.lit("")).alias("text"), F.coalesce(h["page"], F.lit(0)).alias("page"), F.coalesce(h["category"], F.lit("unknown")).alias("category"), F.coalesce(h["reason"], F.lit("")).alias("reason")))


def category_queries(text: Column, wanted: Column) -> Column:
    """Map of the wanted categories to their queries; blank ones are left out."""
    parsed = tolerant_json(text, "map<string,string>")
    return F.map_filter(parsed, lambda k, v: F.array_contains(wanted, k) & (F.trim(v) != ""))


SUMMARY_FIELDS = ("tldr", "problem", "method", "dataset", "result", "contribution")


def paper_summary(text: Column) -> Column:
    """struct of the summary's fields (blank is null) and up to five claims; null without a tldr."""
    p = tolerant_json(text, ", ".join(f"{f} string" for f in SUMMARY_FIELDS) + ", key_claims array<string>")
    fields = [F.nullif(F.trim(p[f]), F.lit("")).alias(f) for f in SUMMARY_FIELDS]
    claims = F.coalesce(clean_strings(p["key_claims"], 5), F.array().cast("array<string>")).alias("key_claims")
    return F.when(F.coalesce(F.trim(p["tldr"]), F.lit("")) != "", F.struct(*fields, claims))


def named_items(items: Column, name: str, n: Column, papers: Column) -> Column:
    """Themes or gaps with a name, their description trimmed and their paper numbers resolved to the papers."""
    kept = F.filter(items, lambda i: F.coalesce(F.trim(i[name]), F.lit("")) != "")
    return F.transform(kept, lambda i: F.struct(F.trim(i[name]).alias(name), F.coalesce(F.trim(i["description"]), F.lit("")).alias("description"), F.transform(index_list(F.coalesce(i["paper_indexes"], F.array().cast("array<string>")), n), lambda k: F.get(papers, k - 1)).alias("papers")))


def csl_work(text: Column) -> Column:
    """struct(title, authors, year) of a CSL-JSON work: first title, names joined by commas, first date part."""
    p = F.from_json(text, "title array<string>, author array<struct<given:string,family:string>>, issued struct<`date-parts`:array<array<int>>>")
    names = F.transform(p["author"], lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"])))
    return F.struct(F.get(p["title"], F.lit(0)).alias("title"), F.array_join(names, ", ").alias("authors"), F.get(F.get(p["issued"]["date-parts"], F.lit(0)), F.lit(0)).alias("year"))


def catalogue_work(text: Column, most_authors: int = 5) -> Column:
    """struct(id, title, year, authors, references) of a catalogue's work; ids are the last part of their addresses."""
    p = F.from_json(text, "id string, title string, publication_year int, authorships array<struct<author:struct<display_name:string>>>, referenced_works array<string>")
    short = lambda u: F.element_at(F.split(u, "/"), -1)
    return F.struct(short(p["id"]).alias("id"), p["title"].alias("title"), p["publication_year"].alias("year"), F.slice(F.transform(p["authorships"], lambda a: a["author"]["display_name"]), 1, most_authors).alias("authors"), F.transform(p["referenced_works"], short).alias("references"))
