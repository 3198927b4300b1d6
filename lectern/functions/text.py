"""Text expressions: tokens, set similarity, predicates on blocks and chunks, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identifiers import bound


def search_tokens(text: Column) -> Column:
    """Lower-case ASCII letter and digit runs, in order."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda t: t != "")


def word_set(text: Column) -> Column:
    """Distinct words between blanks, lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[ \t\r\n]+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of two arrays of distinct values; 0 where either is empty."""

    def share(of: Column) -> Column:
        return F.when((of["a"] > 0) & (of["b"] > 0), of["shared"] / (of["a"] + of["b"] - of["shared"])).otherwise(F.lit(0.0))

    def sizes(of: Column) -> Column:
        return F.struct(F.size(of["a"]).alias("a"), F.size(of["b"]).alias("b"), F.size(F.array_intersect(of["a"], of["b"])).alias("shared"))

    return bound(bound(F.struct(a.alias("a"), b.alias("b")), sizes), share)


def title_words(title: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9 ]", ""), " +"), lambda t: t != ""))


def title_similarity(a: Column, b: Column) -> Column:
    return jaccard(title_words(a), title_words(b))


def normalised_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "))


def title_matches(cited: Column, title: Column) -> Column:
    """One normalised title holds the other, or half of the cited title's words are in the other."""

    def half(of: Column) -> Column:
        return F.size(F.array_intersect(of["c"], of["t"])) * 2 >= F.size(of["c"])

    def matches(of: Column) -> Column:
        c, t = of["c"], of["t"]
        words = F.struct(F.array_distinct(F.split(c, " ")).alias("c"), F.array_distinct(F.split(t, " ")).alias("t"))
        return (c != "") & (t != "") & (F.contains(t, c) | F.contains(c, t) | bound(words, half))

    return bound(F.struct(normalised_title(cited).alias("c"), normalised_title(title).alias("t")), matches)


def token_count(text: Column) -> Column:
    """The count used where no encoder is loaded: a quarter of the characters."""
    return F.floor(F.length(text) / 4).cast("long")


def truncate_tokens(text: Column, tokens: Column) -> Column:
    return F.substring(text, F.lit(1), (tokens * 4).cast("int"))


def is_quality_chunk(content: Column) -> Column:
    """Long enough to embed: 50 characters, a sentence end, 8 words, and no short line that ends in a digit."""
    s = F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), r"^[ \t\r\n]+|[ \t\r\n]+$", ""))
    marked = F.contains(s, F.lit("[TABLE]")) | F.contains(s, F.lit("[FIGURE CAPTION]")) | F.contains(s, F.lit("[TABLE CAPTION]"))
    plain = s.rlike("[.!?]") & (F.size(F.split(s, r"[ \t\r\n]+")) >= 8) & ~((F.length(s) < 80) & s.rlike("[0-9]$"))
    return (F.length(s) >= 50) & (marked | plain)


# fixed values: the forms of captions, page numbers, list items, reference and appendix headings; the first three and the
# reference headings regardless of case, all of them with Unicode blanks and digits
CAPTION = r"^(Figure|Fig\.?|Table|Tab\.?)\s*\d+[.:)\-\s]"
FIGURE_CAPTION = r"^((?:Figure|Fig\.?)\s*\d+[.:)\-]\s*.+)"
TABLE_CAPTION = r"^((?:Table|Tab\.?)\s*\d+[.:)\-]\s*.+)"
PAGE_NOISE = r"^\d{1,4}$"
LIST_ITEM = r"^[\s]*[-•*]\s|^\d+[.)]\s"
REFERENCE_HEADING = r"^\d*\.?\s*(references|bibliography|works cited|literature cited)"
APPENDIX_WORDS, APPENDIX_LETTER = ("appendix", "supplementary"), r"^\(?[A-Z]\)?\.?\s+\S"


def is_caption(text: Column) -> Column:
    return text.rlike(f"(?iU){CAPTION}")


def is_page_noise(text: Column) -> Column:
    return text.rlike(f"(?U){PAGE_NOISE}")


def is_list_item(text: Column) -> Column:
    return F.trim(text).rlike(f"(?U){LIST_ITEM}")


def is_reference_heading(text: Column) -> Column:
    return F.trim(text).rlike(f"(?iU){REFERENCE_HEADING}")


def is_appendix_heading(text: Column) -> Column:
    s = F.trim(text)
    begins = F.lit(False)
    for word in APPENDIX_WORDS:
        begins = begins | F.startswith(F.lower(s), F.lit(word))
    return begins | s.rlike(f"(?U){APPENDIX_LETTER}")


def clean_markdown(text: Column) -> Column:
    """Emphasis marks, inline code ticks and link targets go; their words stay."""
    linked = F.regexp_replace(text, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(linked, r"\*\*|__|`|~~", ""))


def valid_section_title(title: Column) -> Column:
    t = F.trim(title)
    return F.when(F.length(t).between(1, 200), t)


def page_label(page: Column, end_page: Column) -> Column:
    span = F.concat(F.lit("Pages "), page.cast("string"), F.lit("-"), end_page.cast("string"))
    return F.when(end_page > page, span).otherwise(F.concat(F.lit("Page "), page.cast("string")))


def context_header(page: Column, end_page: Column, section: Column) -> Column:
    label = page_label(page, end_page)
    return F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("["), label, F.lit(" · "), section, F.lit("]"))).otherwise(F.concat(F.lit("["), label, F.lit("]")))


def contextual_prefix(title: Column, section: Column, content: Column) -> Column:
    """Embedding input of a chunk: the paper and the section it stands in, then its text without NULs."""
    blank = F.lit("(untitled)")
    t, s = (F.coalesce(F.nullif(F.trim(c), F.lit("")), blank) for c in (title, section))
    return F.concat(F.lit("Paper: "), t, F.lit("\nSection: "), s, F.lit("\n\n"), F.replace(content, F.lit("\x00"), F.lit("")))


def conversation_title(text: Column, limit: int = 60) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def is_text_document(text: Column) -> Column:
    return F.length(F.trim(F.regexp_replace(text, r"--- PAGE [0-9]+ ---", ""))) >= 100


# fixed value: the form of an explanation block in old notes
LEGACY_NOTE = r"(?:^|\n{2,})\[AI Explanation\s*[—-]\s*([^\]]+)\]\s*([\s\S]*?)(?=\n{2,}\[AI Explanation\s*[—-]|\s*$)"


def user_note(note: Column) -> Column:
    """A note without the explanation blocks that older versions wrote into it; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(note, LEGACY_NOTE, ""), r"^\s+|\s+$", "")), F.lit(""))


def explanation(metadata: Column, note: Column) -> Column:
    """The explanation in the metadata, else the last one written into the note."""
    blocks = F.regexp_extract_all(F.coalesce(note, F.lit("")), F.lit(LEGACY_NOTE), F.lit(2))
    return F.coalesce(F.get_json_object(metadata, "$.ai_explanation.content"), F.nullif(F.trim(F.try_element_at(blocks, F.lit(-1))), F.lit("")))
