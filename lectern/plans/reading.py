"""Queries of labels and references, of texts read with offsets, and of the collection's workflows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import text as tx
from ..operators import reading, search
from ..sources.tables import scoped, table
from . import model

BLANK_LINES = ".\n\n"


def prompt_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", lb.prompt_hash(F.concat(F.lit("Summarise: "), F.coalesce("text", F.lit("")))).alias("prompt_sha256"))


def uuid_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of one or two identifiers in several spellings, some with a part that is none, some empty."""
    key = F.col("c_custkey")
    plain = F.regexp_replace(F.md5(key.cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    other = F.concat(F.lit(" {"), F.upper(F.md5((key + 1).cast("string"))), F.lit("} "))
    listed = F.when(key % 5 == 0, F.lit(" , ")).when(key % 7 == 0, F.concat(plain, F.lit(",x"), key.cast("string"))).when(key % 3 == 0, plain).otherwise(F.concat(plain, F.lit(","), other))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(lb.uuid_list(listed), ",").alias("ids"))


def page_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 90 + 1
    answer = F.concat(F.lit("See [Page "), n.cast("string"), F.lit("] and [Pages "), (n + 2).cast("string"), F.lit("-"), (n + 4).cast("string"), F.lit(" · "), F.col("lang"), F.lit("], not [Page x] or [page 3]. "), "text")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lb.start_pages(answer), ",").alias("pages"))


def author_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author lists as a card shows them: short, long with several names, long with one."""
    name, key = F.col("c_name"), F.col("c_custkey")
    authors = F.when(key % 4 == 0, name).when(key % 4 == 1, F.concat_ws(", ", name, name, name, name)).when(key % 4 == 2, F.concat_ws("; ", F.lit(""), name, F.col("c_mktsegment"), name, name)).otherwise(F.repeat(F.concat(name, F.lit(" ")), 5))
    return table(spark, sf_dir, "customer").select("c_custkey", lb.short_authors(authors).alias("label"))


def author_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of one region stand for works with authors in common; surnames are compared without case."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey)
    listed = F.concat(F.lit("Ann "), F.lower("n_name"), F.lit(", , B. "), F.col("r_name"))
    names = F.array(F.concat(F.lit("Z Y "), F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name")).otherwise(F.lit("Nobody"))), F.when(F.col("n_nationkey") % 3 == 0, F.upper("n_name")).otherwise(F.lit(" ")))
    return rows.select("n_nationkey", lb.authors_overlap(listed, names).alias("overlap"))


def utc_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", lb.utc_stamp(F.col("ts")).alias("stamp"))


def highlight_set_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_set(F.concat(F.col("event_type"), F.lit("_points")))).alias("categories"))
    return kinds.select("user_id", lb.set_name(F.col("categories")).alias("name"))


def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", lb.heading_level(F.col("p_size").cast("double"), F.lit(16.0), F.endswith(F.col("p_brand"), F.lit("1"))).alias("level"))


def json_field_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k") == "7").select("event_id", "user_id")


def array_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached entries of exactly these categories and pages: each user's event types and hours of a day on which there are two."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_set("event_type")).alias("categories"), F.sort_array(F.collect_set(F.hour("ts") % 3)).alias("pages"))
    same = (F.col("categories") == F.array(F.lit("click"), F.lit("view"))) & (F.col("pages") == F.array(F.lit(0), F.lit(1)))
    return e.where(same).select("user_id", "day")


def bulk_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each collection by what a bulk run does with them; those at work already are left alone."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    status = F.when(F.col("doc_id") % 11 == 0, "generating").when(F.col("quality").isNull(), "not_generated").when(F.col("quality") == 0, "failed").otherwise("complete")
    rows = docs.select("doc_id", "source").join(labels.select("doc_id", "quality"), "doc_id", "left").select("source", status.alias("status"))
    candidate = F.col("status").isin("not_generated", "failed")
    return rows.groupBy("source").agg(F.count_if(candidate).alias("candidates"), F.count_if(F.col("status") == "complete").alias("skipped_complete"), F.count_if(F.col("status") == "generating").alias("in_flight"))


def passage_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


def papers_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers of a collection that have a complete summary, in their order, numbered without gaps, as one text."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    refs = docs.select("source", "doc_id", "lang", F.coalesce("n_chars", F.lit(0)).alias("ordinal")).withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("ordinal", "doc_id"))).where("k <= 50")
    kept = refs.join(labels, "doc_id").withColumn("number", F.row_number().over(Window.partitionBy("source").orderBy("k")))
    block = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), F.col("lang"), F.lit(" ("), F.col("ordinal").cast("string"), F.lit(")\nTL;DR: "), F.col("doc_id").cast("string"))
    texts = kept.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("number", block.alias("block")))).alias("blocks"))
    return texts.select("source", F.size("blocks").alias("paper_count"), F.sha2(F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n"), 256).alias("bundle_sha256"))


def attempt_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose failures since the last purchase, which sets the count back, are fewer than the attempts allowed."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase"))
    last = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))).alias("reset"))
    since = e.where("event_type = 'error'").join(last, "user_id", "right").groupBy("user_id").agg(F.count_if(F.col("reset").isNull() | (F.struct("ts", "event_id") > F.col("reset"))).alias("attempts"))
    return since.where(F.col("attempts") < lb.MOST_ATTEMPTS)


def stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn's words as frames, the bytes cut anew every 11 characters, put together and cut at blank lines."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant' and text is not null").select(F.concat_ws("-", "conv_id", "turn").alias("message"), F.split("text", " ").alias("words"))
    frames = F.concat(F.lit(": hello\n\n"), F.array_join(F.transform("words", lambda w: F.concat(F.lit("data: "), w)), "\n\n"), F.lit("\n\n"), F.lit("data: cut o"))
    body = turns.select("message", frames.alias("body"))
    cut = body.select("message", "body", F.explode(F.sequence(F.lit(0), F.floor((F.length("body") - 1) / 11))).alias("k")).select("message", "k", F.substring("body", (F.col("k") * 11 + 1).cast("int"), F.lit(11)).alias("piece"))
    out = reading.stream_frames(cut, "message", "k", "piece").where("data <> ''")
    return out.groupBy("message").agg(F.count(F.lit(1)).alias("n_frames"), F.sum(F.length("data")).alias("chars"))


def _pages_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), F.lit(". "), F.lit(BLANK_LINES)).alias("text"))


def paragraph_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reading.paragraphs(_pages_of_text(spark, sf_dir), "doc_id", "text")
    return out.select("doc_id", "start", "end", F.sha2("paragraph", 256).alias("paragraph_sha256"))


def sentence_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the last sentence of each text begins, with and without regard to abbreviations."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", *(reading.sentence_start(F.col("text"), F.lit(0), F.length("text"), skip).alias(name) for name, skip in (("forward", True), ("back", False))))


def heading_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with headings of each form put between their sentences."""
    d = _pages_of_text(spark, sf_dir)
    head = F.concat(F.lit("[HEADING L2] Start of "), F.col("doc_id").cast("string"), F.lit("\nResults\n\n3.1 Some Detail\n\nAn Overview Of Everything\n\nnot a Heading here at all\n\n"))
    return reading.headings(d.select("doc_id", F.concat(head, F.regexp_replace(F.lower("text"), "[^a-z]+", " ")).alias("text")), "doc_id", "text")


def page_text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns stand for the text items of a page; every third ends with a blank."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    items = c.withColumn("text", F.when(F.col("turn") % 3 == 0, F.concat(F.col("text"), F.lit(" "))).otherwise(F.col("text")))
    pages, ranges = reading.page_texts(items, "conv_id", "turn", "text")
    return ranges.join(pages, "conv_id").select("conv_id", "turn", "start", "end", F.sha2(F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")), 256).alias("item_sha256"), F.length("text").alias("chars"))


def section_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a document with headings of three levels between them, which stay open over pages."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, (F.col("o_totalprice").cast("long") % 3 + 1).cast("int")).alias("level"), F.concat(F.col("o_orderpriority"), F.col("o_orderkey").cast("string")).alias("title"))
    out = reading.section_paths(o, "o_custkey", "o_orderkey", "level", "title", deepest=3)
    return out.select("o_orderkey", F.array_join("section_path", " > ").alias("path"))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").where("n_nationkey < 10")
    return n.select(F.col("n_nationkey").alias("pdf_id"), F.when(F.col("n_nationkey") % 4 == 0, "Same title").otherwise(F.col("n_name")).alias("pdf_title"), F.when(F.col("n_nationkey") % 3 > 0, F.lower("n_name")).alias("authors"), F.when(F.col("n_nationkey") % 2 == 0, 1990 + F.col("n_nationkey")).alias("year"))


def paper_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers behind the best chunks, each title once, in the order in which they were found, as lines of a prompt."""
    top = search.vector_top_k(model.vectors(spark, sf_dir), model.query_vector(spark, sf_dir), 30).join(_members(spark, sf_dir), "pdf_id")
    first = Window.partitionBy("pdf_title").orderBy(F.desc("score"), "id")
    once = top.withColumn("k", F.row_number().over(first)).where("k = 1")
    numbered = once.withColumn("number", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    line = F.concat(F.col("number").cast("string"), F.lit(". "), F.col("pdf_title"), F.coalesce(F.concat(F.lit(" — "), F.col("authors")), F.lit("")), F.coalesce(F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")")), F.lit("")))
    return numbered.select("number", line.alias("line"))


def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search of a collection by meaning and words, three times the limit, as it comes, with snippets."""
    members = _members(spark, sf_dir).select("pdf_id", "pdf_title")
    out = search.hybrid_search(model.chunks(spark, sf_dir).join(members, "pdf_id"), model.query_vector(spark, sf_dir), model.text_index(spark, sf_dir).matches(model.TERMS), 5 * 3)
    return out.select("id", "pdf_id", "pdf_title", "page_number", F.sha2(F.substring("content", 1, 300), 256).alias("snippet_sha256"), "combined_score")


def explain_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context of an explanation: the four best chunks of one document, with page labels, in one text."""
    rows = scoped(model.chunks(spark, sf_dir), pdf_id=3)
    top = search.hybrid_search(rows, model.query_vector(spark, sf_dir), model.text_index(spark, sf_dir).matches(model.TERMS), 4)
    part = F.concat(tx.context_header(F.col("page_number"), F.col("end_page_number"), F.lit(None).cast("string")), F.lit("\n"), "content")
    listed = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("combined_score")).alias("s"), "id", part.alias("part")))).alias("parts"))
    return listed.select(F.size("parts").alias("n_chunks"), F.sha2(F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n---\n\n"), 256).alias("context_sha256"))


def capped_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of 50, at most six chunks of a document, those numbered anew and put in a reranker's order, the best eight."""
    top = search.vector_top_k(model.vectors(spark, sf_dir), model.query_vector(spark, sf_dir), 50)
    pool = search.cap_per_document(top, "pdf_id", "score", 6).withColumn("ordinal", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1)
    scores = spark.range(0, 60).select(F.col("id").cast("int").alias("ordinal"), ((F.col("id") * 37) % 101).alias("rerank_score"))
    return search.rerank(pool, scores, 8).select("id", "pdf_id", "ordinal", "rerank_score")


QUERIES = {f.__name__: f for f in (prompt_hashes, uuid_lists, page_references, author_labels, author_overlap, utc_stamps, highlight_set_names, heading_levels, json_field_filter, array_equality, bulk_status, passage_chars, papers_bundle, attempt_limit, stream_frames, paragraph_offsets, sentence_starts, heading_parse, page_text_index, section_stack, paper_metadata, semantic_search, explain_context, capped_rerank)}

WITH = "WITH " + model.SQL
_UUID = "regexp_replace(md5(c_custkey::VARCHAR), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')"
_NEXT = _UUID.replace("c_custkey::VARCHAR", "(c_custkey + 1)::VARCHAR")
_SHORT = "|".join(a.replace(".", "[.]") for a in reading.ABBREVIATIONS)
_PAGES = "SELECT doc_id, replace(replace(text, chr(10), ' '), '. ', '.' || chr(10) || chr(10)) AS t FROM documents WHERE text IS NOT NULL"
_MEMBERS = """m AS (SELECT n_nationkey AS pdf_id, CASE WHEN n_nationkey % 4 = 0 THEN 'Same title' ELSE n_name END AS pdf_title,
  CASE WHEN n_nationkey % 3 > 0 THEN lower(n_name) END AS authors, CASE WHEN n_nationkey % 2 = 0 THEN 1990 + n_nationkey END AS year FROM nation WHERE n_nationkey < 10)"""
_FUSE = "round(coalesce(v.score, 0) * 0.7 + coalesce(k.kw, 0) * 0.3, 6)"
SQL = {
    "prompt_hashes": "SELECT doc_id, sha256('Summarise: ' || coalesce(text, '')) AS prompt_sha256 FROM documents",
    "uuid_lists": f"""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN {_UUID} ELSE {_UUID} || ',' || {_NEXT} END AS ids FROM customer""",
    "page_references": r"""WITH t AS (SELECT doc_id, 'See [Page ' || (doc_id % 90 + 1) || '] and [Pages ' || (doc_id % 90 + 3) || '-' || (doc_id % 90 + 5) || ' · ' || lang || '], not [Page x] or [page 3]. ' || text AS a FROM documents)
      SELECT doc_id, array_to_string(regexp_extract_all(coalesce(a, ''), '\[Pages? (\d+)(-\d+)?(\s*·\s*[^\]]+)?\]', 1), ',') AS pages FROM t""",
    "author_labels": """WITH t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN concat_ws(', ', c_name, c_name, c_name, c_name) WHEN 2 THEN '; ' || concat_ws('; ', c_name, c_mktsegment, c_name, c_name) ELSE repeat(c_name || ' ', 5) END AS a FROM customer)
      SELECT c_custkey, CASE WHEN length(a) <= 60 THEN a WHEN regexp_matches(trim(a, ' ,;'), '[,;]') THEN trim(regexp_extract(a, '[^,; ][^,;]*')) || ' et al.' ELSE substr(a, 1, 57) || '…' END AS label FROM t""",
    "author_overlap": """SELECT n_nationkey, lower(r_name) = regexp_extract(lower(CASE WHEN n_nationkey % 2 = 0 THEN r_name ELSE 'Nobody' END), '[^ ]+$')
        OR (n_nationkey % 2 = 0 AND regexp_extract(lower(r_name), '[^ ]+$') IN (regexp_extract(lower(n_name), '[^ ]+$'), regexp_extract(lower(r_name), '[^ ]+$')))
        OR (n_nationkey % 3 = 0) AS overlap
      FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "utc_stamps": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') || ' UTC' AS stamp FROM events",
    "highlight_set_names": """SELECT user_id, 'AI: ' || string_agg(upper(event_type[1]) || substr(event_type, 2) || '_Points', ', ' ORDER BY event_type || '_points') AS name FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id""",
    "heading_levels": "SELECT p_partkey, CASE WHEN p_brand LIKE '%1' THEN CASE WHEN p_size > 32 THEN 1 WHEN p_size > 25.6 THEN 2 WHEN p_size > 20.8 THEN 3 END END AS level FROM part",
    "json_field_filter": "SELECT event_id, user_id FROM events WHERE props LIKE '%\"k\": 7}%'",
    "array_equality": """SELECT user_id, ts::DATE AS day FROM events GROUP BY ALL
      HAVING list_sort(list(DISTINCT event_type)) = ['click', 'view'] AND list_sort(list(DISTINCT hour(ts) % 3)) = [0, 1]""",
    "bulk_status": """WITH s AS (SELECT source, CASE WHEN doc_id % 11 = 0 THEN 'g' WHEN quality IS NULL OR quality = 0 THEN 'c' ELSE 'd' END AS s FROM documents LEFT JOIN labels USING (doc_id))
      SELECT source, count(*) FILTER (s = 'c') AS candidates, count(*) FILTER (s = 'd') AS skipped_complete, count(*) FILTER (s = 'g') AS in_flight FROM s GROUP BY source""",
    "passage_chars": "SELECT source, sum(coalesce(length(text), 0))::BIGINT AS chars FROM documents GROUP BY source",
    "papers_bundle": """WITH r AS (SELECT source, doc_id, lang, coalesce(n_chars, 0) AS o, row_number() OVER (PARTITION BY source ORDER BY coalesce(n_chars, 0), doc_id) AS k FROM documents),
      n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k) AS i FROM r WHERE k <= 50 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))
      SELECT source, count(*)::INT AS paper_count, sha256(string_agg('[' || i || '] ' || lang || ' (' || o || ')' || chr(10) || 'TL;DR: ' || doc_id, chr(10) || chr(10) ORDER BY i)) AS bundle_sha256 FROM n GROUP BY source""",
    "attempt_limit": """WITH n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('error', 'purchase')),
      r AS (SELECT user_id, coalesce(max(k) FILTER (event_type = 'purchase'), 0) AS reset FROM n GROUP BY user_id)
      SELECT user_id, count(*) FILTER (event_type = 'error' AND k > reset) AS attempts FROM n JOIN r USING (user_id) GROUP BY user_id HAVING count(*) FILTER (event_type = 'error' AND k > reset) < 3""",
    "stream_frames": """WITH w AS (SELECT conv_id || '-' || turn AS message, unnest(string_split(text, ' ')) AS w FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)
      SELECT message, count(*) AS n_frames, sum(length(w))::BIGINT AS chars FROM w WHERE w <> '' GROUP BY message""",
    "sentence_starts": f"""WITH t AS (SELECT doc_id, text, regexp_replace(text, '(?i)({_SHORT})[.!?]', '\\1_', 'g') AS masked FROM documents WHERE text IS NOT NULL),
      e AS (SELECT doc_id, length(regexp_extract(masked, '(?s)^(.*[.!?]\\s+)[A-Z]', 1)) AS f, length(regexp_extract(text, '(?s)^(.*[.!?]\\s+)[A-Z]', 1)) AS b FROM t)
      SELECT doc_id, CASE WHEN f > 0 THEN f ELSE -1 END AS forward, CASE WHEN b > 0 THEN b ELSE -1 END AS back FROM e""",
    "heading_parse": """WITH d AS (SELECT doc_id, 'Start of ' || doc_id AS s, length('[HEADING L2] Start of ' || doc_id) + 1 AS n FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, 0 AS at, s AS title, 2 AS level FROM d UNION ALL SELECT doc_id, n, 'Results', 1 FROM d
      UNION ALL SELECT doc_id, n + 9, 'Some Detail', 2 FROM d UNION ALL SELECT doc_id, n + 26, 'An Overview Of Everything', 2 FROM d""",
    "paragraph_offsets": f"""WITH t AS ({_PAGES}), p AS (SELECT doc_id, string_split(t, chr(10) || chr(10)) AS ps FROM t),
      f AS (SELECT doc_id, unnest(ps) AS p, unnest(generate_series(1, len(ps)::BIGINT)) AS k FROM p),
      o AS (SELECT *, sum(length(p) + 2) OVER (PARTITION BY doc_id ORDER BY k) - length(p) - 2 AS start FROM f)
      SELECT doc_id, start::BIGINT AS start, (start + length(p))::BIGINT AS end, sha256(regexp_replace(p, '^\\s+|\\s+$', '', 'g')) AS paragraph_sha256 FROM o WHERE regexp_replace(p, '^\\s+|\\s+$', '', 'g') <> ''""",
    "page_text_index": r"""WITH i AS (SELECT conv_id, turn, coalesce(CASE WHEN turn % 3 = 0 THEN min(text) || ' ' ELSE min(text) END, '') AS s FROM conversations GROUP BY conv_id, turn),
      g AS (SELECT *, coalesce((NOT regexp_matches(lag(s) OVER w, '\s$') AND NOT regexp_matches(s, '^\s'))::INT, 0) AS gap FROM i WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
      r AS (SELECT *, sum(length(s) + gap) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM g)
      SELECT conv_id, turn, (e - length(s))::BIGINT AS start, e::BIGINT AS end, sha256(s) AS item_sha256, (max(e) OVER (PARTITION BY conv_id))::INT AS chars FROM r""",
    "section_stack": """WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN trunc(o_totalprice)::BIGINT % 3 + 1 END AS l, o_orderpriority || o_orderkey AS t FROM orders),
      h AS (SELECT a.o_orderkey, b.t, b.l, b.o_orderkey AS at FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.o_orderkey <= a.o_orderkey AND b.l IS NOT NULL
        WHERE NOT EXISTS (SELECT 1 FROM o c WHERE c.o_custkey = a.o_custkey AND c.o_orderkey > b.o_orderkey AND c.o_orderkey <= a.o_orderkey AND c.l <= b.l))
      SELECT o.o_orderkey, coalesce(string_agg(h.t, ' > ' ORDER BY h.at), '') AS path FROM o LEFT JOIN h USING (o_orderkey) GROUP BY o.o_orderkey""",
    "paper_metadata": f"""{WITH}, {_MEMBERS}, t AS (SELECT * FROM (SELECT * FROM vectors ORDER BY score DESC, id LIMIT 30) JOIN m USING (pdf_id)),
      u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pdf_title ORDER BY score DESC, id) AS k FROM t) WHERE k = 1),
      n AS (SELECT *, row_number() OVER (ORDER BY score DESC, id)::INT AS number FROM u)
      SELECT number, number || '. ' || pdf_title || coalesce(' — ' || authors, '') || coalesce(' (' || year || ')', '') AS line FROM n""",
    "semantic_search": f"""{WITH}, {_MEMBERS}, c AS (SELECT words.*, pdf_title FROM words JOIN m USING (pdf_id)),
      v AS (SELECT * FROM c ORDER BY score DESC, id LIMIT 30), k AS (SELECT * FROM c WHERE kw IS NOT NULL ORDER BY kw DESC, id LIMIT 15)
      SELECT coalesce(v.id, k.id) AS id, coalesce(v.pdf_id, k.pdf_id) AS pdf_id, coalesce(v.pdf_title, k.pdf_title) AS pdf_title, coalesce(v.page_number, k.page_number) AS page_number,
        sha256(substr(coalesce(v.content, k.content), 1, 300)) AS snippet_sha256, {_FUSE} AS combined_score FROM v FULL OUTER JOIN k ON v.id = k.id ORDER BY combined_score DESC, 1 LIMIT 15""",
    "explain_context": f"""{WITH}, c AS (SELECT * FROM words WHERE pdf_id = 3),
      v AS (SELECT * FROM c ORDER BY score DESC, id LIMIT 8), k AS (SELECT * FROM c WHERE kw IS NOT NULL ORDER BY kw DESC, id LIMIT 4),
      f AS (SELECT coalesce(v.id, k.id) AS id, coalesce(v.page_number, k.page_number) AS p, coalesce(v.end_page_number, k.end_page_number) AS e, coalesce(v.content, k.content) AS content, {_FUSE} AS s FROM v FULL OUTER JOIN k ON v.id = k.id ORDER BY s DESC, 1 LIMIT 4)
      SELECT count(*)::INT AS n_chunks, sha256(string_agg('[' || CASE WHEN e > p THEN 'Pages ' || p || '-' || e ELSE 'Page ' || p END || ']' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY s DESC, id)) AS context_sha256 FROM f""",
    "capped_rerank": f"""{WITH}, t AS (SELECT * FROM vectors ORDER BY score DESC, id LIMIT 50), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pdf_id ORDER BY score DESC, id) AS k FROM t) WHERE k <= 6),
      n AS (SELECT *, (row_number() OVER (ORDER BY score DESC, id) - 1)::INT AS ordinal FROM c)
      SELECT id, pdf_id, ordinal, (ordinal * 37) % 101 AS rerank_score FROM n ORDER BY rerank_score DESC, ordinal LIMIT 8""",
}
