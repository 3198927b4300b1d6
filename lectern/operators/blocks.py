"""Pages of Markdown or of marked text to typed blocks, and the elements of a page in one order.

Lines are rows; what is open at a line (a fence, a table, a paragraph) follows from counts over the lines before it, so a
page is read by windows and its blocks are groups of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import text as tx
from . import reading

PAGE = 1 << 32  # a block's place is its page times this and its first line


def _lines(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    return pages.select(F.col(doc), F.col(page), F.posexplode(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")).alias("line_no", "line"))


def markdown_blocks(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, page, place, block_type, content, section_path) of Markdown pages, page by page.

    A fence up to its end, a table with its head and a run of text lines are one block each; items of a list are blocks of
    their own.  Headings may be marked in front or underlined, and stay open over pages.  Headings' titles and captions are
    cleaned of marks, other contents are the lines as they stand; a page number alone is no block.
    """
    line = F.col("line")
    order = Window.partitionBy(doc, page).orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    # a fence opens and closes: the lines of an odd number of fence marks before and at them are inside
    mark = line.rlike(r"^ {0,3}(```|~~~)")
    marked = _lines(pages, doc, page, text).withColumn("marks", F.sum(mark.cast("int")).over(upto))
    inside = F.col("marks") % 2 == 1
    ends = ~inside & mark
    code = inside | ends
    bare = F.trim(line)
    rule = line.rlike(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$") & F.contains(line, F.lit("|"))
    kinds = marked.select(
        doc, page, "line_no", "line", "marks", code.alias("code"), ((inside & mark) | ends).alias("mark"),
        (~code & (bare == "")).alias("blank"), (~code & line.rlike("^ {0,3}#{1,6}([ \t]|$)")).alias("head"), (~code & rule).alias("rule"),
        (~code & line.rlike(r"^ {0,3}(=+|-+)[ \t]*$")).alias("under"), (~code & line.rlike(r"^[ \t]*([-*+•]|[0-9]{1,9}[.)])[ \t]+[^ \t]")).alias("item"),
        (~code & line.rlike(r"^ {0,3}([-*_][ \t]*){3,}$")).alias("line_across"),
    )
    # lines that text cannot run over cut the page into stretches; a stretch's table begins at its first line above a rule
    last = F.lag("line_no").over(order).isNull()
    cut = F.col("blank") | F.col("head") | F.col("mark") | F.coalesce(F.lag(F.col("blank") | F.col("head")).over(order), F.lit(True)) | (F.col("code") != F.coalesce(F.lag("code").over(order), F.lit(False)))
    stretched = kinds.withColumn("stretch", F.sum(F.when(F.col("code"), (F.col("mark") & (F.col("marks") % 2 == 1)).cast("int")).otherwise((cut | last).cast("int"))).over(upto))
    stretch = Window.partitionBy(doc, page, "stretch").orderBy("line_no")
    table_head = ~F.col("code") & F.contains("line", F.lit("|")) & ~F.col("rule") & F.coalesce(F.lead("rule").over(stretch), F.lit(False))
    tabled = stretched.withColumn("table", F.max(table_head.cast("int")).over(stretch.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    # an underline makes a heading of the text above it; without text, dashes are a line across
    text_above = F.coalesce(F.lag(~F.col("blank") & ~F.col("head") & ~F.col("table") & ~F.col("code") & ~F.col("item")).over(stretch), F.lit(False))
    titled = tabled.withColumn("under", F.col("under") & ~F.col("table") & text_above)
    fresh = F.lag("line_no").over(stretch).isNull() | (F.col("table") != F.coalesce(F.lag("table").over(stretch), F.lit(False))) | (F.col("item") & ~F.col("table")) | F.coalesce(F.lag("under").over(stretch), F.lit(False))
    numbered = titled.where("not blank and not (line_across and not under and not code)").withColumn("fresh", fresh.cast("int"))
    block = numbered.withColumn("block", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    listed = block.groupBy(doc, page, "block").agg(
        F.min("line_no").alias("line_no"), F.first("code").alias("code"), F.max("head").alias("head"), F.max("table").alias("table"), F.max("under").alias("under"),
        F.sort_array(F.collect_list(F.when(~(F.col("code") & F.col("mark")), F.struct("line_no", "line")))).alias("lines"),
    )
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    above = F.array_join(F.transform(F.slice("lines", 1, F.greatest(F.size("lines") - 1, F.lit(1))), lambda x: x["line"]), "\n")
    title = tx.clean_markdown(F.when(F.col("under"), above).otherwise(F.regexp_replace(F.regexp_replace(body, "^ {0,3}#{1,6}[ \t]*", ""), "[ \t]+#+[ \t]*$", "")))
    last_line = F.element_at("lines", -1)["line"]
    level = F.when(F.col("head"), F.length(F.regexp_extract(body, "^ {0,3}(#{1,6})", 1))).when(F.col("under"), F.when(F.contains(last_line, F.lit("=")), 1).otherwise(2))
    plain = tx.clean_markdown(body)
    kind = F.when(F.col("code"), "code").when(F.col("table"), "table").when(F.col("head") | F.col("under"), "heading").when(tx.is_page_noise(plain), None).when(tx.is_caption(plain), "caption").otherwise("paragraph")
    typed = listed.select(doc, page, (F.col(page).cast("long") * PAGE + F.col("line_no")).alias("place"), kind.alias("block_type"), body.alias("body"), plain.alias("plain"), level.alias("level"), title.alias("title"))
    typed = typed.where("block_type is not null and trim(body) <> ''").withColumn("level", F.when(F.col("block_type") == "heading", F.col("level")))
    content = F.when(F.col("block_type") == "caption", F.col("plain")).when(F.col("block_type") == "code", F.concat("body", F.lit("\n"))).otherwise(F.col("body"))
    return reading.section_paths(typed, doc, "place", "level", "title").select(doc, page, "place", "block_type", content.alias("content"), "section_path")


def marked_blocks(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, page, place, block_type, content, section_path) of pages whose parts stand between blank lines.

    ``[HEADING Ln] title`` opens a section, ``[TABLE]`` to ``[/TABLE]`` is a table of the lines between, ``[FIGURE CAPTION]`` and
    ``[TABLE CAPTION]`` begin captions; anything else is a paragraph.
    """
    parts = pages.select(doc, page, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n\n")).alias("k", "part"))
    bare = F.regexp_replace("part", r"^\s+|\s+$", "")
    found = parts.select(doc, page, (F.col(page).cast("long") * PAGE + F.col("k")).alias("place"), bare.alias("part")).where("part <> ''")
    heading = r"^\[HEADING L(\d+)\]\s+(.+)$"
    is_heading, inner = F.col("part").rlike(heading), F.regexp_extract("part", r"(?s)\[TABLE\]\n?(.*?)\n?\[/TABLE\]", 1)
    kind = F.when(is_heading, "heading").when(F.startswith("part", F.lit("[TABLE]")), "table").when(F.col("part").rlike(r"^\[(FIGURE|TABLE) CAPTION\]"), "caption").otherwise("paragraph")
    closed = F.contains("part", F.lit("[/TABLE]"))
    typed = found.select(
        doc, page, "place", kind.alias("block_type"), F.when((kind == "table") & closed, F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(F.col("part")).alias("content"),
        F.when(is_heading, F.regexp_extract("part", heading, 1).cast("int")).alias("level"), F.regexp_extract("part", heading, 2).alias("title"),
    )
    return reading.section_paths(typed, doc, "place", "level", "title").select(doc, page, "place", "block_type", "content", "section_path")


def annotated(elements: DataFrame, kind: str, content: str) -> DataFrame:
    """Text elements that begin like a caption become structure of their own, marked as such."""
    figure, table = (F.trim(F.col(content)).rlike(f"(?i){p}") & (F.col(kind) == "text") for p in (tx.FIGURE_CAPTION, tx.TABLE_CAPTION))
    named = F.when(figure, F.concat(F.lit("\n[FIGURE CAPTION] "), content, F.lit("\n"))).when(table, F.concat(F.lit("\n[TABLE CAPTION] "), content, F.lit("\n"))).otherwise(F.col(content))
    return elements.withColumn("__kind", F.when(figure, "figure_caption").when(table, "table_caption").otherwise(F.col(kind))).withColumn(content, named).drop(kind).withColumnRenamed("__kind", kind)


def merge_elements(elements: DataFrame, page: str, kind: str, y: str, reading_no: str, key: str) -> DataFrame:
    """Elements of a page in one order: text as it is read, structure by its height put in front of the first text at or below it.

    ``reading_no`` numbers the text elements; adds ``merged_no``.  Heights of text rise to the largest so far, since structure that was
    put in stays in, and so both are one line to sort by.
    """
    order = Window.partitionBy(page).orderBy(reading_no, key)
    is_text = F.col(kind) == "text"
    so_far = F.max(y).over(order.rowsBetween(Window.unboundedPreceding, 0))
    text = elements.where(is_text).withColumn("__at", so_far).withColumn("__turn", F.lit(1)).withColumn("__then", F.col(reading_no).cast("double"))
    rest = elements.where(~is_text).withColumn("__at", F.col(y)).withColumn("__turn", F.lit(0)).withColumn("__then", F.col(y).cast("double"))
    both = Window.partitionBy(page).orderBy("__at", "__turn", "__then", key)
    return text.unionByName(rest).withColumn("merged_no", F.row_number().over(both)).drop("__at", "__turn", "__then")


def page_elements(blocks: DataFrame, page: str, x0: str, y: str, x1: str, key: str, kind: str, content: str, width: float) -> DataFrame:
    """Text blocks in reading order, by columns where a page has them and else by height, merged with its tables and headings."""
    marked = annotated(blocks, kind, content)
    text = blocks.where(F.col(kind) == "text")  # captions too: they count for the columns
    columns = geo.reading_order(text, page, x0, y, x1, key, width).select(page, key, F.col("reading_no").alias("__columns"))
    rows = text.select(page, key, F.row_number().over(Window.partitionBy(page).orderBy(y, x0, key)).alias("__rows"))
    sided = geo.multi_column_pages(text, page, x0, x1, width)
    numbered = columns.join(rows, [page, key]).join(sided, page).select(page, key, F.when(F.col("multi_column"), F.col("__columns")).otherwise(F.col("__rows")).alias("reading_no"))
    return merge_elements(marked.join(numbered, [page, key], "left"), page, kind, y, "reading_no", key)


def joined_pages(elements: DataFrame, page: str, content: str, order: str = "merged_no") -> DataFrame:
    """The text of each page: its elements in order with blank lines between."""
    parts = elements.where(F.col(content) != "").groupBy(page).agg(F.sort_array(F.collect_list(F.struct(order, content))).alias("parts"))
    return parts.select(page, F.array_join(F.transform("parts", lambda p: p[content]), "\n\n").alias("text"))
