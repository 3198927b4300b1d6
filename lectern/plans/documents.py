"""Queries of extracted documents, layout, citations, exports and model replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import json as js
from ..functions import text as tx
from ..operators import blocks, citations, documents
from ..sources.tables import table


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a page marker before each of their lines."""
    d = table(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda s, i: F.concat(F.lit("--- PAGE "), (i + 1).cast("string"), F.lit(" ---\n"), s))
    return d.select("doc_id", F.array_join(lines, "\n").alias("marked"), F.split("text", "\n").alias("lines"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents.pages_of(_marked(spark, sf_dir), "doc_id", "marked")
    return pages.select("doc_id", "page_number", F.sha2("content", 256).alias("content_sha256"))


def truncated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _marked(spark, sf_dir).select("doc_id", documents.truncate_at_page(F.col("marked"), 2000).alias("t"))
    return t.select("doc_id", F.length("t.text").alias("chars"), "t.note")


def summary_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    section = F.when((F.col("doc_id") % 3 == 0) & (F.col("chunk_index") == 2), "ABSTRACT").when((F.col("doc_id") % 4 == 0) & (F.col("chunk_index") >= 4), "5 Conclusions")
    out = documents.summary_sources(d.withColumn("section_title", section), "doc_id")
    return out.select("doc_id", F.sha2("source_text", 256).alias("source_sha256"))


def paper_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(
        "source", F.col("doc_id").alias("position"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.when(F.col("doc_id") % 4 != 0, (1990 + F.col("doc_id") % 30).cast("int")).alias("year"),
        F.col("text").alias("tldr"), F.col("lang").alias("method"), F.lit(None).cast("string").alias("result"), F.array(F.lit("a"), F.col("lang"), F.lit("c"), F.lit("d"), F.lit("e"), F.lit("f")).alias("key_claims"),
    )
    return documents.paper_bundle(d, "source").select("source", F.sha2("bundle", 256).alias("bundle_sha256"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of pages 600 wide from the event numbers: mostly two columns, some across both."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 97).alias("page"), (F.col("event_id") * 37 % 800).alias("y"))
    x0 = F.when(F.col("event_id") % 11 == 0, 20).when(F.col("event_id") % 2 == 0, 40 + F.col("event_id") % 5).otherwise(320 + F.col("event_id") % 7)
    return e.withColumn("x0", x0).withColumn("x1", F.col("x0") + F.when(F.col("event_id") % 11 == 0, 560).otherwise(240))


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.reading_order(_boxes(spark, sf_dir), "page", "x0", "y", "x1", "event_id", 600.0).select("event_id", "page", "side", "reading_no")


def multi_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.multi_column_pages(_boxes(spark, sf_dir), "page", "x0", "x1", 600.0)


def rotated_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    r = geo.rect(F.lit(0.125), (F.col("event_id") % 8) / 16, F.lit(0.25), F.lit(0.0625))
    angle = (F.col("event_id") % 5 * 90).cast("int")
    turned = e.select("event_id", angle.alias("angle"), geo.rotated(r, angle).alias("r"))
    back = geo.unrotated(F.col("r"), F.col("angle"))
    return turned.select("event_id", "r.x", "r.y", "r.w", "r.h", back["y"].alias("back_y"))


def merged_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("page"), (F.col("event_id") % 4 / 8).alias("y"), ((F.col("event_id") * 13 % 64) / 64).alias("x")).withColumns({"w": F.lit(0.015625), "h": F.lit(0.0009765625)})
    return geo.merge_line_rects(e, "page", "x", "y", "w", "h").select("page", "x", "y", "w")


def annotation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations with their own colour or their set's, ordered by their top-most rectangle."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 9).alias("set_id"), F.when(F.col("event_id") % 4 == 0, "#EF4444").alias("color"), (F.col("event_id") * 7 % 100).alias("y1"), (F.col("event_id") * 3 % 100).alias("y2"))
    sets = spark.range(9).select(F.col("id").alias("set_id"), F.concat(F.lit("#00000"), F.col("id").cast("string")).alias("set_color"))
    rects = F.array(geo.rect(F.lit(0.5), F.col("y1") / 100, F.lit(0.1), F.lit(0.1)), geo.rect(F.lit(0.25), F.col("y2") / 100, F.lit(0.1), F.lit(0.1)))
    joined = e.join(sets, "set_id").withColumn("first", geo.first_position(rects))
    return joined.select("event_id", F.coalesce("color", "set_color").alias("color"), F.col("first.y").alias("first_y"), F.col("first.x").alias("first_x"))


def collection_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    cited = F.col("c_custkey") % 3 != 0
    rows = c.join(n, c.c_nationkey == n.n_nationkey).select(
        "n_nationkey", "n_name", "c_custkey", F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("On "), "c_name")).alias("cit_title"), F.lit("A. B.").alias("authors"),
        (F.col("c_custkey") % 4 * 500).cast("int").alias("year"), F.when(F.col("c_custkey") % 2 == 0, "10.1/x").alias("doi"), F.when(cited, F.concat(F.lit("@a{"), "c_name", F.lit("}"))).alias("bibtex"),
    )
    md = citations.collection_export(rows, "n_nationkey", "n_name", "c_custkey", "markdown").select("n_nationkey", F.sha2("export", 256).alias("markdown"))
    bib = citations.collection_export(rows, "n_nationkey", "n_name", "c_custkey", "bibtex").select("n_nationkey", F.sha2("export", 256).alias("bibtex"))
    return md.join(bib, "n_nationkey")


def validate_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("ordinal")), table(spark, sf_dir, "labels")
    return citations.validate(docs, labels, "doc_id", "ordinal")


def auto_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as papers, suppliers as the catalogue of works."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    text = F.concat(F.lit("arXiv:2101."), F.lpad((F.col("c_custkey") % 10000).cast("string"), 5, "0"))
    doi = citations.chosen_doi(F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("https://doi.org/10.1234/s"), (F.col("c_custkey") / 4).cast("long").cast("string"), F.lit("."))), F.lit(" "), F.when(F.col("c_custkey") % 4 == 1, text).otherwise("none"))
    title = citations.chosen_title(F.lit("paper.docx"), F.when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("Study of supplier "), (F.col("c_custkey") % 50).cast("string"))).otherwise("Other things"))
    papers = c.select(F.col("c_custkey").alias("id"), doi.alias("doi"), title.alias("title"), F.lit(None).cast("string").alias("authors"), F.lit(None).cast("int").alias("year"))
    works = s.select(F.concat(F.lit("10.1234/S"), F.col("s_suppkey").cast("string")).alias("doi"), F.concat(F.lit("Study of supplier "), F.col("s_suppkey").cast("string")).alias("title"), F.lit("Cy Doe").alias("authors"), (1980 + F.col("s_suppkey") % 40).cast("int").alias("year"))
    return citations.auto_citations(papers, works).select("id", "doi", "title", "authors", "year", "source")


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries, highlights and queries read from replies that wrap and break their JSON."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id").cast("string")
    summary = F.concat(F.lit('```json\n{"tldr": " t'), n, F.lit('\n", "problem": " ", "method": "m", "key_claims": ["a", " ", "b", "c", "d", "e", "f"]}\n```'))
    found = F.concat(F.lit('[{"text": "q'), n, F.lit('", "page": 2}, {"category": "methods"}]'))
    asked = F.concat(F.lit('{"claims": "c'), n, F.lit('", "methods": " ", "other": "x"}'))
    s, h = js.paper_summary(summary), js.highlights(found)
    q = js.category_queries(asked, F.array(F.lit("claims"), F.lit("methods")))
    return e.select("event_id", s["tldr"].alias("tldr"), s["problem"].alias("problem"), F.array_join(s["key_claims"], "|").alias("claims"), F.array_join(F.transform(h, lambda x: F.concat_ws("/", x["text"], x["page"].cast("string"), x["category"])), ",").alias("highlights"), F.to_json(q).alias("queries"))


def catalogue_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    refs = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.concat(F.lit("https://x.org/W"), "l_partkey"))).alias("refs"))
    work = F.to_json(F.struct(F.concat(F.lit("https://x.org/W"), "l_orderkey").alias("id"), F.lit("T").alias("title"), F.lit(2001).alias("publication_year"), F.col("refs").alias("referenced_works")))
    csl = F.concat(F.lit('{"title": ["T'), F.col("l_orderkey").cast("string"), F.lit('"], "author": [{"given": "A", "family": "B"}, {"family": "C"}], "issued": {"date-parts": [[1999, 2]]}}'))
    w, c = js.catalogue_work(work), js.csl_work(csl)
    return refs.select("l_orderkey", w["id"].alias("id"), F.array_join(w["references"], ",").alias("refs"), w["year"].alias("year"), c["title"].alias("title"), c["authors"].alias("authors"), c["year"].alias("issued"))


def annotation_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.col("event_id").cast("string")
    legacy = F.concat(F.lit("my note "), n, F.lit("\n\n[AI Explanation — 2024]\nfirst\n\n[AI Explanation - 2025]\nsecond "), n)
    note = F.when(F.col("event_id") % 3 == 0, legacy).when(F.col("event_id") % 3 == 1, F.concat(F.lit("plain "), n))
    meta = F.when(F.col("event_id") % 5 == 0, F.lit('{"ai_explanation": {"content": "meta"}}'))
    return e.select("event_id", tx.user_note(note).alias("note"), tx.explanation(meta, note).alias("explanation"))


def key_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature to preferred model and key: own key is unlimited, the shared one counts against the quota."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    features = spark.createDataFrame([("chat", "conversation"), ("explain_paraphrase", "conversation"), ("summary", "analysis")], "feature string, kind string")
    prefs = c.where("user_id % 3 <> 0").select("user_id", F.concat(F.lit("conv-"), (F.col("user_id") % 2).cast("string")).alias("conversation_model"), F.lit("ana").alias("analysis_model"), F.when(F.col("user_id") % 5 == 0, "byok").otherwise("app").alias("mode"))
    asked = c.select("user_id", F.explode(F.array(*(F.lit(f) for f in ("chat", "explain_paraphrase", "summary")))).alias("feature")).join(features, "feature")
    joined = asked.join(prefs, "user_id", "left")
    model = F.when(F.col("kind") == "conversation", F.col("conversation_model")).otherwise(F.col("analysis_model"))
    own = F.coalesce("mode", F.lit("app")) == "byok"
    has_key = F.col("user_id") % 10 == 0
    return joined.select("user_id", "feature", model.alias("model"), F.when(own & ~has_key, "no key").when(own, "own").otherwise("shared").alias("key"), F.when(own, F.lit(None)).otherwise(20).cast("int").alias("quota"))


def legacy_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in marked pages to typed blocks: headings that stay open over pages, tables between their marks, captions."""
    n = F.col("doc_id").cast("string")
    text = F.concat(
        F.lit("--- PAGE 1 ---\n[HEADING L1] Doc "), n, F.lit("\n\n[HEADING L2] Part\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n[TABLE]\n| a |\n| "), n, F.lit(" |\n[/TABLE]\n--- PAGE 2 ---\n[TABLE CAPTION] Table 1: "), n,
        F.lit("\n\n[HEADING L2] Next\n\n"), F.coalesce("text", F.lit("")),
    )
    pages = documents.pages_of(table(spark, sf_dir, "documents").select("doc_id", text.alias("marked")), "doc_id", "marked")
    out = blocks.marked_blocks(pages, "doc_id", "page_number", "content")
    grouped = out.groupBy("doc_id", "page_number", "block_type", F.array_join("section_path", " > ").alias("path"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "content"))), lambda x: x["content"]), "|"), 256).alias("content_sha256"))


QUERIES = {
    f.__name__: f
    for f in (page_texts, truncated_documents, summary_sources, paper_bundle, reading_order, multi_column, rotated_rects, merged_rects, annotation_export, collection_export, validate_citations, auto_citations, model_replies, catalogue_works, annotation_notes, key_resolution, legacy_blocks)
}

_LINES = "SELECT doc_id, unnest(ls) AS line, unnest(generate_series(1, len(ls)::BIGINT)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"
_BOXES = """b AS (SELECT event_id, event_id % 97 AS page, event_id * 37 % 800 AS y, CASE WHEN event_id % 11 = 0 THEN 20 WHEN event_id % 2 = 0 THEN 40 + event_id % 5 ELSE 320 + event_id % 7 END AS x0,
  CASE WHEN event_id % 11 = 0 THEN 560 ELSE 240 END AS w FROM events),
  s AS (SELECT *, CASE WHEN w > 480 THEN 'full' WHEN x0 + w / 2.0 < 300 THEN 'left' ELSE 'right' END AS side FROM b)"""
SQL = {
    "page_texts": f"SELECT doc_id, k::INT AS page_number, sha256(trim(line)) AS content_sha256 FROM ({_LINES})",
    "truncated_documents": f"""WITH l AS ({_LINES}), m AS (SELECT doc_id, k, '--- PAGE ' || k || ' ---' || chr(10) || line AS t FROM l),
      p AS (SELECT *, sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY k) AS upto, sum(length(t) + 1) OVER (PARTITION BY doc_id) - 1 AS total FROM m),
      c AS (SELECT doc_id, max(total) AS total, max(k) FILTER (WHERE upto <= 2000 AND upto < total) AS last FROM p GROUP BY doc_id),
      r AS (SELECT c.doc_id, total, last, length(regexp_replace((SELECT string_agg(t, chr(10) ORDER BY k) FROM m WHERE m.doc_id = c.doc_id AND k <= last), '[ \\t\\r\\n]+$', '')) AS n FROM c)
      SELECT doc_id, CASE WHEN total <= 2000 THEN total WHEN last IS NULL THEN 2000 ELSE n END::INT AS chars,
        CASE WHEN total <= 2000 THEN 'all' WHEN last IS NULL THEN 'partial (truncated at 2000 chars)' ELSE '1-' || last END AS note FROM r""",
    "summary_sources": f"""WITH l AS ({_LINES}), c AS (SELECT doc_id, k - 1 AS i, line FROM l),
      o AS (SELECT doc_id, substr(string_agg(line, ' ' ORDER BY i) FILTER (WHERE i < 3), 1, 3000) AS opening, substr(string_agg(line, ' ' ORDER BY i) FILTER (WHERE i = 2 AND doc_id % 3 = 0), 1, 3000) AS abstract,
        substr(string_agg(line, ' ' ORDER BY i) FILTER (WHERE i IN (4, 5) AND doc_id % 4 = 0), 1, 2500) AS conclusion FROM c GROUP BY doc_id)
      SELECT doc_id, sha256(coalesce(abstract, opening) || CASE WHEN coalesce(conclusion, '') <> '' THEN chr(10) || chr(10) || '[Conclusion]' || chr(10) || conclusion ELSE '' END) AS source_sha256 FROM o""",
    "paper_bundle": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
      b AS (SELECT source, k, substr('[' || k || '] Doc ' || doc_id || CASE WHEN doc_id % 4 <> 0 THEN ' (' || (1990 + doc_id % 30) || ')' ELSE '' END || chr(10) || 'TL;DR: ' || text || chr(10) || 'Method: ' || lang || chr(10) || 'Result: '
        || chr(10) || 'Key claims: a; ' || lang || '; c; d; e', 1, 1200) AS b FROM n WHERE k <= 20)
      SELECT source, sha256(string_agg(b, chr(10) || chr(10) ORDER BY k)) AS bundle_sha256 FROM b GROUP BY source""",
    "reading_order": f"""WITH {_BOXES}, d AS (SELECT *, sum((side = 'full')::INT) OVER (PARTITION BY page ORDER BY y, (side = 'full')::INT DESC, event_id ROWS UNBOUNDED PRECEDING) AS band FROM s)
      SELECT event_id, page, side, row_number() OVER (PARTITION BY page ORDER BY band, CASE side WHEN 'full' THEN 0 WHEN 'left' THEN 1 ELSE 2 END, y, event_id)::INT AS reading_no FROM d""",
    "multi_column": f"""WITH {_BOXES} SELECT page, coalesce(count(*) FILTER (WHERE side = 'left') >= 3 AND count(*) FILTER (WHERE side = 'right') >= 3
      AND min(x0 + w / 2.0) FILTER (WHERE side = 'right') - max(x0 + w / 2.0) FILTER (WHERE side = 'left') > 30, false) AS multi_column FROM s GROUP BY page""",
    "rotated_rects": """WITH r AS (SELECT event_id, event_id % 5 % 4 AS t, 0.125::DOUBLE AS x, (event_id % 8)::DOUBLE / 16 AS y, 0.25::DOUBLE AS w, 0.0625::DOUBLE AS h FROM events)
      SELECT event_id, CASE t WHEN 0 THEN x WHEN 1 THEN 1 - y - h WHEN 2 THEN 1 - x - w ELSE y END AS x, CASE t WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN 1 - y - h ELSE 1 - x - w END AS y,
        CASE WHEN t IN (0, 2) THEN w ELSE h END AS w, CASE WHEN t IN (0, 2) THEN h ELSE w END AS h, y AS back_y FROM r""",
    "merged_rects": """WITH e AS (SELECT event_id % 50 AS page, (event_id % 4)::DOUBLE / 8 AS y, (event_id * 13 % 64)::DOUBLE / 64 AS x FROM events),
      s AS (SELECT *, max(x + 0.015625::DOUBLE) OVER (PARTITION BY page, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
      i AS (SELECT *, sum((reach IS NULL OR x > reach + 0.005::DOUBLE)::INT) OVER (PARTITION BY page, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS k FROM s)
      SELECT page, min(x) AS x, y, max(x) + 0.015625::DOUBLE - min(x) AS w FROM i GROUP BY page, y, k""",
    "annotation_export": """WITH e AS (SELECT event_id, event_id % 9 AS set_id, (event_id * 7 % 100)::DOUBLE / 100 AS y1, (event_id * 3 % 100)::DOUBLE / 100 AS y2 FROM events)
      SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '#EF4444' ELSE '#00000' || set_id END AS color, least(y1, y2) AS first_y, CASE WHEN y2 <= y1 THEN 0.25 ELSE 0.5 END::DOUBLE AS first_x FROM e""",
    "collection_export": """WITH r AS (SELECT n_nationkey, n_name, c_custkey, c_name, c_custkey % 3 <> 0 AS cited, CASE WHEN c_custkey % 5 = 0 THEN 'On ' || c_name ELSE c_name END AS t, c_custkey % 4 * 500 AS y FROM customer JOIN nation ON c_nationkey = n_nationkey),
      g AS (SELECT n_nationkey, n_name, count(*) AS total, count(*) FILTER (WHERE NOT cited) AS missing,
        string_agg(CASE WHEN cited THEN '- **' || t || '** — A. B. (' || CASE WHEN y = 0 THEN '' ELSE y::VARCHAR END || ')' || CASE WHEN c_custkey % 2 = 0 THEN '. [doi](https://doi.org/10.1/x)' ELSE '' END ELSE '- ' || c_name END, chr(10) ORDER BY c_custkey) AS md,
        string_agg('@a{' || c_name || '}', chr(10) || chr(10) ORDER BY c_custkey) FILTER (WHERE cited) AS bib FROM r GROUP BY 1, 2)
      SELECT n_nationkey, sha256('# ' || n_name || chr(10) || chr(10) || CASE WHEN missing > 0 THEN missing || ' of ' || total || ' papers had no citation.' || chr(10) || chr(10) ELSE '' END || md) AS markdown,
        sha256(concat_ws(chr(10), CASE WHEN missing > 0 THEN '% ' || missing || ' of ' || total || ' papers had no citation' END, bib)) AS bibtex FROM g""",
    "validate_citations": "SELECT n_chars AS ordinal, doc_id, doc_id IN (SELECT doc_id FROM labels) AS has_citation FROM documents",
    "auto_citations": """WITH p AS (SELECT c_custkey AS id, c_custkey % 4 AS m, c_custkey // 4 AS q, c_custkey % 50 AS t FROM customer),
      r AS (SELECT *, CASE m WHEN 0 THEN '10.1234/s' || q WHEN 1 THEN '10.48550/arxiv.2101.' || lpad((id % 10000)::VARCHAR, 5, '0') END AS doi, CASE WHEN m = 2 THEN 'Study of supplier ' || t ELSE 'Other things' END AS title,
        CASE WHEN m = 0 AND q IN (SELECT s_suppkey FROM supplier) THEN q WHEN m = 2 AND t IN (SELECT s_suppkey FROM supplier) THEN t END AS hit FROM p)
      SELECT id, CASE WHEN m = 2 AND hit IS NOT NULL THEN '10.1234/S' || hit ELSE doi END AS doi, CASE WHEN hit IS NOT NULL THEN 'Study of supplier ' || hit ELSE title END AS title,
        CASE WHEN hit IS NOT NULL THEN 'Cy Doe' ELSE 'Unknown Author' END AS authors, (CASE WHEN hit IS NOT NULL THEN 1980 + hit % 40 END)::INT AS year,
        CASE WHEN hit IS NULL THEN 'auto' WHEN m = 0 THEN 'lookup' ELSE 'title' END AS source FROM r""",
    "model_replies": """SELECT event_id, 't' || event_id AS tldr, NULL AS problem, 'a|b|c|d|e' AS claims, 'q' || event_id || '/2/unknown,/0/methods' AS highlights, '{"claims":"c' || event_id || '"}' AS queries FROM events""",
    "catalogue_works": """SELECT l_orderkey, 'W' || l_orderkey AS id, string_agg(DISTINCT 'W' || l_partkey, ',' ORDER BY 'W' || l_partkey) AS refs, 2001 AS year, 'T' || l_orderkey AS title, 'A B, C' AS authors, 1999 AS issued
      FROM lineitem GROUP BY l_orderkey""",
    "annotation_notes": """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'my note ' || event_id WHEN 1 THEN 'plain ' || event_id END AS note,
      CASE WHEN event_id % 5 = 0 THEN 'meta' WHEN event_id % 3 = 0 THEN 'second ' || event_id END AS explanation FROM events""",
    "key_resolution": """WITH u AS (SELECT c_custkey AS u, c_custkey % 3 <> 0 AS has, c_custkey % 3 <> 0 AND c_custkey % 5 = 0 AS own FROM customer)
      SELECT u AS user_id, feature, CASE WHEN has THEN CASE feature WHEN 'summary' THEN 'ana' ELSE 'conv-' || (u % 2) END END AS model,
        CASE WHEN own AND u % 10 <> 0 THEN 'no key' WHEN own THEN 'own' ELSE 'shared' END AS key, CASE WHEN NOT own THEN 20 END AS quota
      FROM u, (VALUES ('chat'), ('explain_paraphrase'), ('summary')) f(feature)""",
    "legacy_blocks": r"""WITH p AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10) || chr(10))) AS part, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10) || chr(10)))::BIGINT)) AS k FROM documents),
      t AS (SELECT doc_id, k, regexp_replace(part, '^[ \t\r\n\x0B\x0C]+|[ \t\r\n\x0B\x0C]+$', '', 'g') AS content FROM p),
      g AS (SELECT doc_id, count(*) AS n, sha256(string_agg(content, '|' ORDER BY k)) AS h FROM t WHERE content <> '' GROUP BY doc_id)
      SELECT doc_id, 1 AS page_number, 'paragraph' AS block_type, 'Doc ' || doc_id || ' > Part' AS path, n, h AS content_sha256 FROM g
      UNION ALL SELECT doc_id, 2, 'paragraph', 'Doc ' || doc_id || ' > Next', n, h FROM g
      UNION ALL SELECT doc_id, 1, 'heading', 'Doc ' || doc_id, 1, sha256('[HEADING L1] Doc ' || doc_id) FROM documents
      UNION ALL SELECT doc_id, 1, 'heading', 'Doc ' || doc_id || ' > Part', 1, sha256('[HEADING L2] Part') FROM documents
      UNION ALL SELECT doc_id, 2, 'heading', 'Doc ' || doc_id || ' > Next', 1, sha256('[HEADING L2] Next') FROM documents
      UNION ALL SELECT doc_id, 1, 'table', 'Doc ' || doc_id || ' > Part', 1, sha256('| a |' || chr(10) || '| ' || doc_id || ' |') FROM documents
      UNION ALL SELECT doc_id, 2, 'caption', 'Doc ' || doc_id || ' > Part', 1, sha256('[TABLE CAPTION] Table 1: ' || doc_id) FROM documents""",
}
