"""Queries of whole workflows (indexing, highlights, synthesis, Markdown pages) and of the sinks and lookups they use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import json as js
from ..functions import text as tx
from ..operators import blocks, chunking, documents, matching, state
from ..sources import tables
from ..sources.scratch import new_folder
from ..sources.tables import table
from ..streaming import streams


def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to blocks, chunks that are worth embedding and their embedding inputs, written by source; indexed again, a source is replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("Title "), F.col("doc_id").cast("string")).alias("title"), chunking.text_blocks(F.col("text")).alias("blocks"))
    inputs = chunking.embed_inputs(chunking.chunk_documents(docs), docs.select("doc_id", "source", "title"))
    folder = new_folder(spark, "chunks")
    rows = inputs.select("source", "doc_id", "chunk_index", "content", "embed_input")
    tables.write_documents(rows, folder, "source")
    tables.write_documents(rows.where("source = 'src1'"), folder, "source")
    return spark.read.parquet(folder).select(F.col("source").cast("string").alias("source"), "doc_id", "chunk_index", F.sha2("embed_input", 256).alias("input_sha256"))


def highlight_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's reply names quotes; those that stand in the passage are kept, one row each, with their category."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.regexp_replace("text", r"[^A-Za-z0-9 .,]", "").alias("passage"))
    quote = lambda start: F.substring("passage", start, 40)
    reply = F.concat(F.lit('```json\n[{"text": "'), quote(5), F.lit('", "page": 2, "category": "findings", "reason": "a"}, {"text": "'), F.repeat(F.lit("zq"), 20), F.lit('", "category": "methods"}, {"page": 3}]\n```'))
    found = d.select("doc_id", "passage", F.posexplode(js.highlights(reply)).alias("k", "h")).select((F.col("doc_id") * 10 + F.col("k")).alias("id"), "passage", "h.text", "h.page", "h.category")
    verified = matching.verified_highlights(found, "id", "text", "passage").where("verified")
    return found.join(verified.select("id"), "id").select("id", "page", "category", F.length("text").alias("chars"))


def synthesis_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes of a synthesis reply: those without a name are dropped, paper numbers that no paper has too."""
    o = table(spark, sf_dir, "orders")
    reply = F.concat(
        F.lit('{"themes": [{"name": " T'), F.col("o_orderkey").cast("string"), F.lit(' ", "description": " d ", "paper_indexes": ["1", "9", "'), (F.col("o_orderkey") % 4).cast("string"),
        F.lit('"]}, {"name": "  ", "description": "x"}, {"description": "y"}, {"name": "'), F.col("o_orderpriority"), F.lit('"}]}'),
    )
    themes = js.tolerant_json(reply, "themes array<struct<name:string,description:string,paper_indexes:array<string>>>")["themes"]
    papers = F.array(F.lit("p1"), F.lit("p2"), F.lit("p3"))
    named = o.select("o_orderkey", F.posexplode(js.named_items(themes, "name", F.lit(3), papers)).alias("k", "t"))
    return named.select("o_orderkey", "k", "t.name", "t.description", F.array_join("t.papers", ",").alias("papers"))


def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of Markdown as typed blocks under their headings, which stay open over pages: tables, lists and fences of several lines."""
    n, s = F.col("doc_id"), F.col("doc_id").cast("string")
    numbered = lambda most, line: F.array_join(F.transform(F.sequence(F.lit(1), most.cast("int")), line), "")
    table_rows = numbered(n % 4 + 1, lambda i: F.concat(F.lit("| "), i.cast("string"), F.lit(" | "), s, F.lit(" |\n")))
    items = F.when(n % 3 > 0, numbered(n % 3, lambda i: F.concat(F.lit("- item "), i.cast("string"), F.lit(" of "), s, F.lit("\n  more\n")))).otherwise("")
    first = F.concat(
        F.lit("# **Title** "), s, F.lit("\n\nFirst [words](http://x.y) here\nrun on to "), s, F.lit("\n\n12\n\n## Part\nFig. 1. A *caption* of "), s,
        F.lit("\n\nabove\n| a | b |\n|---|:-:|\n"), table_rows, F.lit("\n"), items, F.lit("\n```python\ncode "), s, F.lit("\n\n# none\n```\nTable 3\n\n----\n"),
    )
    second = F.concat(F.lit("carried on "), s, F.lit("\n\nDeep "), s, F.lit("\n---\nlast\n### \n"))
    pages = F.when(n % 2 == 0, F.array(first, second)).otherwise(F.array(first))
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pages).alias("k", "text")).withColumn("page", F.col("k") + 1)
    out = blocks.markdown_blocks(d, "doc_id", "page", "text")
    numbers = F.row_number().over(Window.partitionBy("doc_id").orderBy("place"))
    return out.select("doc_id", "page", numbers.alias("block_no"), "block_type", "content", F.array_join("section_path", " > ").alias("path"))


def owned_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row by its key, if it belongs to who asks; another's is not found."""
    c = table(spark, sf_dir, "customer")
    nation = c.where("c_custkey = 7").select("c_nationkey").first()["c_nationkey"]
    return tables.owned(c, "c_custkey", 7, "c_nationkey", nation).unionByName(tables.owned(c, "c_custkey", 8, "c_nationkey", -1)).select("c_custkey", "c_name")


def jsonl_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as JSON lines and read back."""
    folder = new_folder(spark, "lines")
    tables.write_jsonl(table(spark, sf_dir, "benchmark"), folder)
    return spark.read.schema("item_id long, text string").json(folder).select("item_id", F.sha2("text", 256).alias("text_sha256"))


def json_array_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions as one JSON array in order."""
    return tables.bounded_json_array(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), [F.col("r_regionkey")])


def uploaded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as rows with their size and whether they begin as their kind does: the tables' own files stand for documents."""
    files = tables.binary_documents(spark, f"{sf_dir}/{{region,nation}}.parquet", magic=b"PAR1")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), (F.col("length") == F.octet_length("content")).alias("whole"), "has_magic")


def section_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines can be section titles, and which head a list of references."""
    title = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" 7. References "), F.col("lang"))).when(F.col("doc_id") % 4 == 1, F.lit("   ")).otherwise(F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", title.alias("title"))
    return d.select("doc_id", F.length(tx.valid_section_title(F.col("title"))).alias("chars"), tx.is_reference_heading(F.col("title")).alias("references"))


def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of each order's lines that have shipped by a day, rounded down."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_shipdate") < F.lit("1995-06-17").cast("timestamp")).alias("done"), F.count(F.lit(1)).alias("total"))
    return li.select("l_orderkey", state.progress(F.col("done"), F.col("total")).alias("percent"))


def layout_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order stand for the text spans of a first page: the largest in its upper part are the title."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("Words "), F.col("l_partkey").cast("string")).alias("text"), (F.col("l_quantity") / 10).alias("size"), (F.col("l_linenumber") * 100).cast("double").alias("y"), F.lit(800.0).alias("page_height"))
    return documents.layout_titles(li, "l_orderkey", "l_linenumber")


def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each client in windows of an hour, from a stream."""
    events = streams.event_stream(spark, sf_dir, "events.parquet")
    stream = streams.rate_windows(events.withColumn("client", F.col("user_id") % 5), "client", "ts", "1 hour", late="1 day")
    return streams.run_to_table(stream, new_folder(spark, "rates"), "complete").select("client", F.unix_timestamp("started").alias("started"), "n")


QUERIES = {f.__name__: f for f in (index_documents, highlight_extraction, synthesis_themes, markdown_blocks, owned_lookup, jsonl_sink, json_array_sink, uploaded_files, section_titles, job_progress, layout_title, stream_rates)}

SQL = {
    "highlight_extraction": """WITH d AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9 .,]', '', 'g') AS p FROM documents WHERE text IS NOT NULL),
      q AS (SELECT doc_id, substr(p, 5, 40) AS t FROM d)
      SELECT doc_id * 10 AS id, 2 AS page, 'findings' AS category, length(t)::INT AS chars FROM q WHERE length(trim(regexp_replace(t, ' +', ' ', 'g'))) >= 10""",
    "synthesis_themes": """SELECT o_orderkey, 0 AS k, 'T' || o_orderkey AS name, 'd' AS description, CASE WHEN o_orderkey % 4 IN (2, 3) THEN 'p1,p' || (o_orderkey % 4) ELSE 'p1' END AS papers FROM orders
      UNION ALL SELECT o_orderkey, 1, trim(o_orderpriority), '', '' FROM orders""",
    "markdown_blocks": """WITH b AS (SELECT doc_id, doc_id % 2 = 0 AS two, 'Title ' || doc_id AS h, 'Title ' || doc_id || ' > Part' AS p, doc_id::VARCHAR AS s FROM documents),
      i AS (SELECT *, unnest(generate_series(1, (doc_id % 3)::BIGINT)) AS i FROM b),
      r AS (SELECT doc_id, 1 AS page, 0.0::DOUBLE AS pos, 'heading' AS block_type, '# **Title** ' || s AS content, h AS path FROM b
        UNION ALL SELECT doc_id, 1, 1, 'paragraph', 'First [words](http://x.y) here' || chr(10) || 'run on to ' || s, h FROM b
        UNION ALL SELECT doc_id, 1, 2, 'heading', '## Part', p FROM b
        UNION ALL SELECT doc_id, 1, 3, 'caption', 'Fig. 1. A *caption* of ' || s, p FROM b
        UNION ALL SELECT doc_id, 1, 4, 'paragraph', 'above', p FROM b
        UNION ALL SELECT doc_id, 1, 5, 'table', '| a | b |' || chr(10) || '|---|:-:|' || chr(10) || array_to_string(list_transform(generate_series(1, (doc_id % 4 + 1)::BIGINT), lambda k: '| ' || k || ' | ' || s || ' |'), chr(10)), p FROM b
        UNION ALL SELECT doc_id, 1, 6 + i / 10.0, 'paragraph', '- item ' || i || ' of ' || s || chr(10) || '  more', p FROM i
        UNION ALL SELECT doc_id, 1, 7, 'code', 'code ' || s || chr(10) || chr(10) || '# none' || chr(10), p FROM b
        UNION ALL SELECT doc_id, 1, 8, 'paragraph', 'Table 3', p FROM b
        UNION ALL SELECT doc_id, 2, 9, 'paragraph', 'carried on ' || s, p FROM b WHERE two
        UNION ALL SELECT doc_id, 2, 10, 'heading', 'Deep ' || s || chr(10) || '---', h || ' > Deep ' || s FROM b WHERE two
        UNION ALL SELECT doc_id, 2, 11, 'paragraph', 'last', h || ' > Deep ' || s FROM b WHERE two
        UNION ALL SELECT doc_id, 2, 12, 'heading', '### ', h || ' > Deep ' || s || ' > (untitled)' FROM b WHERE two)
      SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INT AS block_no, block_type, content, path FROM r""",
    "owned_lookup": "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7",
    "jsonl_sink": "SELECT item_id, sha256(text) AS text_sha256 FROM benchmark",
    "json_array_sink": """SELECT '[' || string_agg('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}', ',' ORDER BY r_regionkey) || ']' AS json FROM region""",
    "uploaded_files": "SELECT n AS name, true AS whole, true AS has_magic FROM (VALUES ('region.parquet'), ('nation.parquet')) v(n)",
    "section_titles": r"""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' 7. References ' || lang WHEN 1 THEN '   ' ELSE text END AS t FROM documents)
      SELECT doc_id, CASE WHEN length(trim(t)) BETWEEN 1 AND 200 THEN length(trim(t)) END::INT AS chars, regexp_matches(lower(trim(t)), '^[0-9]*\.?[ \t]*(references|bibliography|works cited|literature cited)') AS references FROM t""",
    "job_progress": "SELECT l_orderkey, (100 * count(*) FILTER (l_shipdate < TIMESTAMP '1995-06-17') // count(*))::INT AS percent FROM lineitem GROUP BY 1",
    "layout_title": """WITH u AS (SELECT *, l_quantity / 10 AS s, max(l_quantity / 10) OVER (PARTITION BY l_orderkey) AS m FROM lineitem WHERE l_linenumber * 100 <= 480)
      SELECT l_orderkey, string_agg('Words ' || l_partkey, ' ' ORDER BY l_linenumber, 'Words ' || l_partkey) AS title FROM u WHERE s >= m - 0.5 GROUP BY 1 HAVING length(string_agg('Words ' || l_partkey, ' ')) BETWEEN 10 AND 300""",
    "stream_rates": "SELECT user_id % 5 AS client, epoch(date_trunc('hour', ts))::BIGINT AS started, count(*) AS n FROM events GROUP BY 1, 2",
}
