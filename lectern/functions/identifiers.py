"""Bibliographic identifiers: DOI, arXiv, ISBN, years, authors, BibTeX, addresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DOI = r"10\.[0-9]{4,9}/[^ \t\r\n\"<>]+"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def clean_doi(raw: Column) -> Column:
    """A DOI without the punctuation that ended its sentence; a closing bracket goes when nothing opened it."""

    def unbracketed(cut: Column, opened: str, closed: str) -> Column:
        surplus = F.length(F.replace(cut, F.lit(opened), F.lit(""))) - F.length(F.replace(cut, F.lit(closed), F.lit("")))
        return F.when(F.endswith(cut, F.lit(closed)) & (surplus > 0), F.regexp_replace(cut, r"[\)\].,;:]+$", "")).otherwise(cut)

    cut = F.regexp_replace(raw, r"[.,;:'\"]+$", "")
    return bound(bound(cut, lambda c: unbracketed(c, "(", ")")), lambda c: unbracketed(c, "[", "]"))


def extract_doi(text: Column) -> Column:
    return clean_doi(F.nullif(F.regexp_extract(text, f"(?i)({DOI})", 1), F.lit("")))


def is_doi(text: Column) -> Column:
    return text.rlike(f"(?i)^{DOI}$")


def normalise_doi(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(text), r"(?i)^(https?://(dx\.)?doi\.org/|doi:[ ]*)", ""))


def arxiv_doi(text: Column) -> Column:
    """DOI of the arXiv identifier in a text, without its version."""
    found = F.nullif(F.regexp_extract(text, r"(?i)arxiv:[ ]*([0-9]{4}\.[0-9]{4,5})", 1), F.lit(""))
    return F.concat(F.lit("10.48550/arxiv."), found)


def valid_isbn(text: Column) -> Column:
    """The ISBN without separators where its check digit is right, else null."""
    bare = F.upper(F.regexp_replace(text, "[- ]", ""))

    def digit(i: int) -> Column:
        c = F.substring(bare, i + 1, 1)
        return F.when(c == "X", 10).otherwise(F.try_to_number(c, F.lit("9")).cast("int"))

    ten = sum(((10 - i) * digit(i) for i in range(1, 10)), 10 * digit(0)) % 11 == 0
    thirteen = sum(((1 if i % 2 == 0 else 3) * digit(i) for i in range(1, 13)), digit(0)) % 10 == 0
    return F.when(bare.rlike("^[0-9]{9}[0-9X]$") & ten, bare).when(bare.rlike("^[0-9]{13}$") & thirteen, bare)


def first_year(text: Column) -> Column:
    """The first number that can be a year; digits of a DOI or of an arXiv number are none."""
    bare = F.regexp_replace(text, rf"(?i){DOI}|arxiv:[ ]*[0-9]{{4}}\.[0-9]{{4,5}}", " ")
    return F.nullif(F.regexp_extract(bare, r"\b((?:19|20)[0-9]{2})\b", 1), F.lit("")).cast("int")


def first_author(authors: Column) -> Column:
    return F.nullif(F.trim(F.split_part(authors, F.lit(","), F.lit(1))), F.lit(""))


def surname(authors: Column) -> Column:
    return F.element_at(F.split(F.coalesce(first_author(authors), F.lit("unknown")), " +"), -1)


def bibtex(authors: Column, title: Column, year: Column, doi: Column) -> Column:
    """A minimal entry whose key is surname and year; absent fields are left out."""
    key = F.concat(F.lower(surname(authors)), F.coalesce(year.cast("string"), F.lit("nd")))

    def entry(name: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), value, F.lit("}")))

    body = F.concat_ws(",\n", entry("title", title), entry("author", authors), entry("year", year.cast("string")), entry("doi", doi))
    return F.concat(F.lit("@article{"), key, F.lit(",\n"), body, F.lit("\n}"))


def is_junk_title(title: Column) -> Column:
    """File names, placeholders, bare arXiv numbers and titles of one word."""
    return title.rlike(r"(?i)\.(docx?|indd|dvi|tex|qxd)\b|^untitled$|^arxiv:[ ]*[0-9]{4}\.[0-9]{4,5}") | (F.size(F.split(F.trim(title), " +")) < 2)


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1), F.lit(""))), r"^www\.", "")


def short_id(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def is_safe_url(url: Column) -> Column:
    """http(s) with a public host name or address; nothing is resolved."""
    h = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))
    private = r"^(localhost|.*\.local|.*\.internal|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|0\..*|\[?::1\]?)$"
    return url.rlike("^(?i)https?://") & (h != "") & ~h.rlike(private)


def masked_key(key: Column) -> Column:
    return F.concat(F.lit("••••"), F.right(key, F.lit(4)))


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_")


def expand_ranges(text: Column) -> Column:
    """Numbers of a list such as ``1-3,7``; null where a part is not a number or a rising range."""
    parts = F.split(F.regexp_replace(text, " ", ""), ",")
    valid = text.isNotNull() & F.forall(parts, lambda p: p.rlike(r"^[0-9]{1,6}(-[0-9]{1,6})?$") & (F.split_part(p, F.lit("-"), F.lit(1)).try_cast("int") <= F.coalesce(F.split_part(p, F.lit("-"), F.lit(2)).try_cast("int"), F.lit(1 << 30))))
    low = lambda p: F.split_part(p, F.lit("-"), F.lit(1)).try_cast("int")
    high = lambda p: F.coalesce(F.split_part(p, F.lit("-"), F.lit(2)).try_cast("int"), low(p))
    return F.when(valid, F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(low(p), high(p)))))))
