"""Small expressions on labels, references and keys: page references, author lists, names, identifiers, levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the form of a page reference in an answer, and the names of highlight categories
PAGE_REFERENCE = r"\[Pages? (\d+)(?:-(\d+))?(?:\s*[·]\s*[^\]]+)?\]"
MOST_ATTEMPTS = 3
_UUID = r"^\{?[0-9a-f]{32}\}?$"


def prompt_hash(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def uuid_list(listed: Column) -> Column:
    """Identifiers of a comma list in their plain form; null if one of them is none, empty where there are none."""
    parts = F.filter(F.transform(F.split(F.coalesce(listed, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    bare = F.transform(parts, lambda x: F.regexp_replace(F.lower(x), "urn:|uuid:|-", ""))
    plain = F.transform(bare, lambda x: F.regexp_replace(F.translate(x, "{}", ""), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    return F.when(F.forall(bare, lambda x: x.rlike(_UUID)), plain)


def start_pages(text: Column) -> Column:
    """First page of each page reference in a text, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PAGE_REFERENCE), F.lit(1)), lambda n: n.cast("int"))


def short_authors(authors: Column, limit: int = 60) -> Column:
    """A list of authors that fits a card: whole up to 60 characters, else the first and others, or cut."""
    names = F.filter(F.transform(F.split(authors, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.length(authors) <= limit, authors).when(F.size(names) > 1, F.concat(names[0], F.lit(" et al."))).otherwise(F.concat(F.substring(authors, 1, limit - 3), F.lit("…")))


def utc_stamp(ts: Column) -> Column:
    """Minute of an instant, in a session that runs in UTC."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit(" UTC"))


def set_name(categories: Column) -> Column:
    """Name of a set of highlights: its categories with capitals."""
    return F.concat(F.lit("AI: "), F.array_join(F.transform(categories, lambda c: F.replace(F.initcap(F.replace(c, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("_"))), ", "))


def _surnames(names: Column) -> Column:
    full = F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(full, lambda x: F.lower(F.element_at(F.split(x, r"\s+"), -1)))


def authors_overlap(listed: Column, names: Column) -> Column:
    """Whether a comma list of authors and an array of names share a surname (a name's last word)."""
    return F.arrays_overlap(_surnames(F.split(listed, ",")), _surnames(names))


def heading_level(size: Column, median: Column, bold: Column) -> Column:
    """Level of a bold line by its size against the page's median; null where it is no heading."""
    ratio = size / median
    return F.when(bold & (ratio > 1.3), F.when(ratio > 2.0, 1).when(ratio > 1.6, 2).otherwise(3))
