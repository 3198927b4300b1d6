"""Text to blocks to chunks: block types by expressions, chunks by an ordered fold over each document's blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

CHUNK_TOKENS, OVERLAP_TOKENS = 400, 64
ATOMIC = ("table", "equation", "code")
BLOCK_TYPE = "array<struct<block_type:string,content:string,page_number:int,section_path:array<string>>>"
DOCS_AT_ONCE = 64
CHUNK_DDL = "doc_id long, chunk_index int, page_number int, end_page_number int, content string, section_title string, section_level int, chunk_type string"


def block_type(line: Column) -> Column:
    """Type of a block of text by its first characters; page noise is null."""
    return (
        F.when(tx.is_page_noise(F.trim(line)), F.lit(None))
        .when(line.rlike(r"^#{1,6} "), "heading")
        .when(line.rlike(r"^[ ]*\|.*\|[ ]*$"), "table")
        .when(line.rlike(r"^(\$\$|\\\[)"), "equation")
        .when(line.rlike("^(```|    )"), "code")
        .when(tx.is_caption(F.trim(line)), "caption")
        .when(F.trim(line) != "", "paragraph")
    )


def text_blocks(text: Column, lines_per_page: int = 40) -> Column:
    """Lines of a text as typed blocks; a page is ``lines_per_page`` lines."""
    lines = F.transform(
        F.split(text, "\n"),
        lambda s, i: F.struct(
            block_type(s).alias("block_type"),
            F.trim(s).alias("content"),
            (F.floor(i / lines_per_page) + 1).cast("int").alias("page_number"),
            F.array().cast("array<string>").alias("section_path"),
        ),
    )
    return F.filter(lines, lambda b: b["block_type"].isNotNull())


_LIST, _REFERENCES, _LETTERED = re.compile(tx.LIST_ITEM), re.compile(tx.REFERENCE_HEADING, re.IGNORECASE), re.compile(tx.APPENDIX_LETTER)


def is_appendix(title: str) -> bool:
    return title.lower().startswith(tx.APPENDIX_WORDS) or bool(_LETTERED.match(title))


def token_count(text: str) -> int:
    return len(text) // 4


def worth_keeping(text: str) -> bool:
    text = text.strip()
    if len(text) < 50:
        return False
    if any(mark in text for mark in ("[TABLE]", "[FIGURE CAPTION]", "[TABLE CAPTION]")):
        return True
    short = len(text) < 80 and text[-1] in "0123456789"
    return bool(re.search(r"[.!?]", text)) and len(text.split()) >= 8 and not short


def section_of(path: list[str] | None) -> tuple[str | None, int | None]:
    """The deepest title of a section path that can be a title (up to 200 characters), and its level."""
    for level in range(len(path) if path is not None else 0, 0, -1):
        title = (path[level - 1] or "").strip()
        if 0 < len(title) <= 200:
            return title, level
    return None, None


@dataclass
class Fold:
    """State carried over a document's blocks: open paragraphs, finished chunks, whether references are skipped."""

    size: int = CHUNK_TOKENS
    overlap: int = OVERLAP_TOKENS
    open: list[tuple[str, int, str | None, int | None]] = field(default_factory=list)
    done: list[dict] = field(default_factory=list)
    skipping: bool = False

    def emit(self, kind: str, text: str, first: int, last: int, title: str | None, level: int | None) -> None:
        self.done.append({"page_number": first, "end_page_number": last, "content": text, "section_title": title, "section_level": level, "chunk_type": kind})

    def flush(self) -> None:
        text = "\n\n".join(p[0] for p in self.open).strip()
        if worth_keeping(text):
            self.emit("paragraph", text, self.open[0][1], self.open[-1][1], *self.open[-1][2:])
        self.open = []

    def tail(self) -> list[tuple[str, int, str | None, int | None]]:
        """Whole trailing paragraphs within the overlap; the last one in any case."""
        at, held = len(self.open), 0
        while at and (at == len(self.open) or held + token_count(self.open[at - 1][0]) <= self.overlap):
            at -= 1
            held += token_count(self.open[at][0])
        return self.open[at:]

    def paragraph(self, text: str, page: int, title: str | None, level: int | None) -> None:
        joined = token_count("\n\n".join([*(p[0] for p in self.open), text]))
        in_list = joined <= 2 * self.size and _LIST.match(text) and any(_LIST.match(p[0]) for p in self.open)
        if self.open and joined > self.size and not in_list:
            carried = self.tail()
            self.flush()
            self.open = carried
        self.open.append((text, page, title, level))

    def block(self, kind: str, content: str | None, page: int, path: list[str] | None) -> None:
        title, level = section_of(path)
        text = (content or "").strip()
        if kind == "heading":
            if title and _REFERENCES.match(title):
                self.flush()
                self.skipping = True
            elif not self.skipping or (title and is_appendix(title)):
                self.flush()
                self.skipping = False
        elif self.skipping or (not text and kind not in ATOMIC):
            return
        elif kind in ATOMIC:
            self.flush()
            if text:
                self.emit(kind, text, page, page, title, level)
        elif kind == "caption":
            before = self.done[-1] if self.done and not self.open else None
            if before and before["chunk_type"] in ATOMIC:
                before["content"] += "\n\n" + text
                before["end_page_number"] = max(before["end_page_number"], page)
            else:
                self.flush()
                self.emit("caption", text, page, page, title, level)
        else:
            self.paragraph(text, page, title, level)


def chunks_of(blocks, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[dict]:
    fold = Fold(size, overlap)
    for b in blocks if blocks is not None else ():
        fold.block(b["block_type"], b["content"], b["page_number"], b["section_path"])
    fold.flush()
    return [{"chunk_index": i, **c} for i, c in enumerate(fold.done)]


def chunk_documents(docs: DataFrame, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Typed, token-bounded chunks of documents given as (doc_id, blocks): no exchange, a document is one row.

    Of a batch, ``DOCS_AT_ONCE`` documents at a time are Python objects.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in CHUNK_DDL.split(", "))])
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                docs = batch.slice(at, DOCS_AT_ONCE).to_pylist()
                rows = [{"doc_id": d["doc_id"], **c} for d in docs for c in chunks_of(d["blocks"], size, overlap)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select("doc_id", "blocks").mapInArrow(run, CHUNK_DDL)


def embed_inputs(chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """Chunks with the text that is embedded: paper title and section before the content."""
    return chunks.join(titles, "doc_id").withColumn("embed_input", tx.contextual_prefix(F.col("title"), F.col("section_title"), F.col("content")))


def carry_sections(lines: DataFrame, group: str, position: str, title: Column, most_repeats: int = 3) -> DataFrame:
    """Section of each line: the last heading before it, where headings seen more often than allowed are running headers."""
    from pyspark.sql import Window

    named = lines.withColumn("__title", title)
    times = F.count("__title").over(Window.partitionBy(group, "__title"))
    kept = named.withColumn("__title", F.when(times <= most_repeats, F.col("__title")))
    upto = Window.partitionBy(group).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return kept.withColumn("section", F.last("__title", ignorenulls=True).over(upto)).drop("__title")
