"""Queries of pages as they are seen: elements in order, ranges as rectangles, quotes found again, the shared view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import blocks, dml, library, matching
from ..sources.tables import table


def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks of pages in one and in two columns, merged with tables, headings and captions at their heights."""
    e = F.col("event_id")
    page = e % 97
    full = (e % 11 == 0) | (page % 3 == 0)  # every third page has one column
    x0 = F.when(full, 20).when(e % 2 == 0, 40 + e % 5).otherwise(320 + e % 7)
    kind = F.when(e % 13 == 0, "table").when(e % 17 == 0, "heading").otherwise("text")
    content = F.concat(F.when(e % 19 == 0, F.lit("Figure 3: seen ")).when(e % 23 == 0, F.lit("tab. 4) ")).when(e % 29 == 0, F.lit("Figure 3 shows ")).otherwise(F.lit("words ")), e.cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", page.alias("page"), (e * 37 % 800).alias("y"), x0.alias("x0"), kind.alias("kind"), content.alias("content"))
    rows = rows.withColumn("x1", F.col("x0") + F.when(full, 560).otherwise(240))
    out = blocks.page_elements(rows, "page", "x0", "y", "x1", "event_id", "kind", "content", 600.0)
    joined = blocks.joined_pages(out, "page", "content").select("page", F.sha2("text", 256).alias("page_sha256"))
    return out.select("event_id", "page", "kind", "merged_no").join(joined, "page")


def range_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of characters as rectangles on pages in every turn: items in lines of four, some with blanks at their ends."""
    c = F.col("l_linenumber")
    text = F.when(c % 3 == 0, "  ab cd ").otherwise("abcdefgh")
    line, place = F.floor((c - 1) / 4), (c - 1) % 4
    li = table(spark, sf_dir, "lineitem").where("l_orderkey % 4 = 0")
    turned = F.when(c % 5 == 0, F.array(*(F.lit(x) for x in (0.0, 10.0, -10.0, 0.0)))).otherwise(F.array(*(F.lit(x) for x in (10.0, 0.0, 0.0, 10.0))))
    transform = F.concat(turned, F.array((place * 100).cast("double"), (700 - line * 20).cast("double")))
    items = li.select(F.col("l_orderkey").alias("page"), ((c - 1) * 9).cast("long").alias("start"), ((c - 1) * 9 + 8).cast("long").alias("end"), text.alias("str"), transform.alias("transform"), F.lit(96.0).alias("width"), F.when(c % 2 == 0, 0.0).otherwise(10.0).alias("height")).dropDuplicates(["page", "start"])
    pages = items.select("page").distinct().select("page", F.lit(400.0).alias("page_width"), F.lit(800.0).alias("page_height"), (F.col("page") % 16 / 4 * 90).cast("int").alias("rotation"))
    ranges = pages.select(F.col("page").alias("range_id"), "page", (F.col("page") % 13).alias("from"), (F.col("page") % 13 + F.col("page") % 47).alias("to"))
    out = geo.range_rects(ranges, items, pages).select("range_id", F.posexplode("rects").alias("k", "r"))
    return out.select("range_id", "k", *(F.round(f"r.{c}", 6).alias(c) for c in "xywh"))


def quote_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote of each document whose page number is off by none to three: found on its own page, else up to two away."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    upto = Window.partitionBy("source").orderBy(F.asc_nulls_last("doc_id"))
    name = F.col("doc_id").cast("string")
    quote = F.concat(F.lit("begins "), F.md5(name.cast("binary")), F.md5(F.concat(F.lit("x"), name).cast("binary")))
    numbers = d.select("source", "doc_id").withColumn("page", F.row_number().over(upto))  # without the texts, as a source is one task
    pages = numbers.join(d.select("doc_id", "text"), "doc_id").select("source", "page", F.concat(F.lit("Here "), quote, F.lit(" "), F.col("text")).alias("text"))
    quotes = numbers.where("doc_id is not null").select(F.col("doc_id").alias("quote_id"), "source", (F.col("page") + F.col("doc_id") % 4).alias("page"), F.when(F.col("doc_id") % 3 == 0, F.upper(quote)).otherwise(quote).alias("quote"))
    return matching.relocate_quotes(quotes, pages, "quote_id").select("quote_id", F.col("page").cast("int").alias("page"), "method", "start", "prefix")


def shared_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a share's link shows: the set, its paper, who shared it by their best name, and notes for those who may comment."""
    c = table(spark, sf_dir, "conversations")
    sets = c.select(F.col("conv_id").alias("set_id")).distinct().select("set_id", (F.col("set_id") % 30).alias("pdf_id"), F.when(F.col("set_id") % 3 != 0, "#00FF00").alias("color"))
    shares = sets.where("set_id % 4 <> 3").select(F.concat(F.lit("t"), F.col("set_id").cast("string")).alias("token"), "set_id", (F.col("set_id") % 20).alias("shared_by"), F.when(F.col("set_id") % 2 == 0, "comment").otherwise("view").alias("permission"))
    notes = c.where("conv_id % 5 <> 4").select(F.col("conv_id").alias("set_id"), "turn", F.col("text").alias("note"))
    pdfs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pdf_id"), F.col("n_name").alias("title"))
    users = table(spark, sf_dir, "supplier").where("s_suppkey % 7 <> 1").select(F.col("s_suppkey").alias("user_id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("display_name"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("login")).alias("login"))
    return library.shared_view(shares, sets, notes, pdfs, users)


def model_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new column filled from the first of two old ones that has a value; rows that have it already keep it."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("chat-"), "c_custkey")).alias("chat_model"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("explain-"), "c_custkey")).alias("explain_model"), F.when(F.col("c_custkey") % 5 == 0, "kept").alias("conversation_model"))
    return dml.backfill(c, "conversation_model", "chat_model", "explain_model").select("c_custkey", "conversation_model")


QUERIES = {f.__name__: f for f in (page_elements, range_rects, quote_pages, shared_view, model_backfill)}

_ITEMS = """i AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS c, (l_linenumber - 1) // 4 AS line, (l_linenumber - 1) % 4 AS place, l_orderkey % 13 AS f, l_orderkey % 13 + l_orderkey % 47 AS t FROM lineitem WHERE l_orderkey % 4 = 0),
      o AS (SELECT *, greatest(0, f - (c - 1) * 9) AS a, least(8, t - (c - 1) * 9) AS b FROM i WHERE (c - 1) * 9 < t AND (c - 1) * 9 + 8 > f),
      e AS (SELECT *, CASE WHEN c % 3 = 0 AND a = 0 THEN 2 ELSE a END AS lo, CASE WHEN c % 3 = 0 AND b = 8 THEN 7 ELSE b END AS hi FROM o),
      x AS (SELECT *, (place * 100 + CASE WHEN c % 5 = 0 THEN 0 ELSE 96.0::DOUBLE * lo / 8 END) / 400 AS x, (800 - (700 - line * 20) - 10) / 800.0::DOUBLE AS y, 96.0::DOUBLE * (hi - lo) / 8 / 400 AS w, 10 / 800.0::DOUBLE AS h FROM e WHERE lo < hi),
      s AS (SELECT *, max(x + w) OVER (PARTITION BY page, line ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
      m AS (SELECT *, sum((reach IS NULL OR x > reach + greatest(0.005, h * 4))::INT) OVER (PARTITION BY page, line ORDER BY x ROWS UNBOUNDED PRECEDING) AS run FROM s),
      r AS (SELECT page, line, run, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, min(h) AS h, page % 16 // 4 AS turn FROM m GROUP BY page, line, run)"""
SQL = {
    "page_elements": rf"""WITH b AS (SELECT event_id, event_id % 97 AS page, event_id * 37 % 800 AS y, event_id % 11 = 0 OR event_id % 97 % 3 = 0 AS wide,
        CASE WHEN event_id % 13 = 0 THEN 'table' WHEN event_id % 17 = 0 THEN 'heading' ELSE 'text' END AS kind0,
        CASE WHEN event_id % 19 = 0 THEN 'Figure 3: seen ' WHEN event_id % 23 = 0 THEN 'tab. 4) ' WHEN event_id % 29 = 0 THEN 'Figure 3 shows ' ELSE 'words ' END || event_id AS c0 FROM events),
      s AS (SELECT *, CASE WHEN wide THEN 20 WHEN event_id % 2 = 0 THEN 40 + event_id % 5 ELSE 320 + event_id % 7 END AS x0, CASE WHEN wide THEN 560 ELSE 240 END AS w FROM b),
      t AS (SELECT *, CASE WHEN w > 480 THEN 'full' WHEN x0 + w / 2.0 < 300 THEN 'left' ELSE 'right' END AS side,
        CASE WHEN kind0 = 'text' AND event_id % 19 = 0 THEN 'figure_caption' WHEN kind0 = 'text' AND event_id % 23 = 0 THEN 'table_caption' ELSE kind0 END AS kind,
        CASE WHEN kind0 = 'text' AND event_id % 19 = 0 THEN chr(10) || '[FIGURE CAPTION] ' || c0 || chr(10) WHEN kind0 = 'text' AND event_id % 23 = 0 THEN chr(10) || '[TABLE CAPTION] ' || c0 || chr(10) ELSE c0 END AS content FROM s),
      d AS (SELECT *, sum((side = 'full')::INT) OVER (PARTITION BY page ORDER BY y, (side = 'full')::INT DESC, event_id ROWS UNBOUNDED PRECEDING) AS band FROM t WHERE kind0 = 'text'),
      m AS (SELECT page, coalesce(count(*) FILTER (WHERE side = 'left') >= 3 AND count(*) FILTER (WHERE side = 'right') >= 3
        AND min(x0 + w / 2.0) FILTER (WHERE side = 'right') - max(x0 + w / 2.0) FILTER (WHERE side = 'left') > 30, false) AS multi FROM d GROUP BY page),
      n AS (SELECT d.*, CASE WHEN multi THEN row_number() OVER (PARTITION BY d.page ORDER BY band, CASE side WHEN 'full' THEN 0 WHEN 'left' THEN 1 ELSE 2 END, y, event_id)
        ELSE row_number() OVER (PARTITION BY d.page ORDER BY y, x0, event_id) END AS no FROM d JOIN m USING (page)),
      k AS (SELECT t.event_id, t.page, t.kind, t.content, t.y, CASE WHEN t.kind = 'text' THEN (SELECT no FROM n WHERE n.event_id = t.event_id)
        ELSE coalesce((SELECT min(no) FROM n WHERE n.page = t.page AND n.kind = 'text' AND n.y >= t.y), 1000000000) END AS slot FROM t),
      o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY slot, kind = 'text', CASE WHEN kind <> 'text' THEN y END, event_id)::INT AS merged_no FROM k),
      p AS (SELECT page, sha256(string_agg(content, chr(10) || chr(10) ORDER BY merged_no)) AS page_sha256 FROM o GROUP BY page)
      SELECT event_id, page, kind, merged_no, page_sha256 FROM o JOIN p USING (page)""",
    "range_rects": f"""WITH {_ITEMS} SELECT page AS range_id, (row_number() OVER (PARTITION BY page ORDER BY line, r.x) - 1)::INT AS k,
        round(CASE turn WHEN 0 THEN x WHEN 1 THEN 1 - y - h WHEN 2 THEN 1 - x - w ELSE y END, 6) AS x, round(CASE turn WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN 1 - y - h ELSE 1 - x - w END, 6) AS y,
        round(CASE WHEN turn IN (0, 2) THEN w ELSE h END, 6) AS w, round(CASE WHEN turn IN (0, 2) THEN h ELSE w END, 6) AS h FROM r""",
    "quote_pages": """WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS page FROM documents WHERE text IS NOT NULL)
      SELECT doc_id AS quote_id, page, CASE WHEN doc_id % 3 = 0 THEN 'normalized' ELSE 'exact' END AS method, 5::BIGINT AS start, 'Here ' AS prefix FROM p WHERE doc_id % 4 <= 2""",
    "shared_view": """WITH s AS (SELECT DISTINCT conv_id AS id FROM conversations)
      SELECT 't' || s.id AS token, s.id AS set_id, s.id % 30 AS pdf_id, coalesce(n_name, 'Unknown PDF') AS pdf_title, CASE WHEN s.id % 2 = 0 THEN 'comment' ELSE 'view' END AS permission,
        CASE WHEN s.id % 3 <> 0 THEN '#00FF00' ELSE '#FFFF00' END AS color, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_name END, CASE WHEN s_suppkey % 3 = 0 THEN 'login' END, 'Unknown') AS shared_by,
        turn, CASE WHEN s.id % 2 = 0 THEN text END AS note
      FROM s LEFT JOIN nation ON n_nationkey = s.id % 30 LEFT JOIN supplier ON s_suppkey = s.id % 20 AND s_suppkey % 7 <> 1 LEFT JOIN conversations c ON c.conv_id = s.id AND s.id % 5 <> 4 WHERE s.id % 4 <> 3""",
    "model_backfill": """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'kept' WHEN c_custkey % 2 = 0 THEN 'chat-' || c_custkey WHEN c_custkey % 3 = 0 THEN 'explain-' || c_custkey END AS conversation_model FROM customer""",
}
