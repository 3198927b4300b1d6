"""Queries of text, identifiers, JSON and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions import json as js
from ..functions import text as tx
from ..operators import chunking, documents, matching
from ..sources.tables import table


def extraction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", tx.is_text_document(F.col("text")).alias("is_text"))
    return documents.extraction_quality(d, "text", "doc_id", "is_text")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def chunk_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).withColumn("good", tx.is_quality_chunk(F.col("line")))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count(F.when(F.col("good"), 1)).alias("n_good"))


def block_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(chunking.block_type(F.col("line")), F.lit("none"))
    return _lines(spark, sf_dir).groupBy(kind.alias("kind"), tx.is_list_item(F.col("line")).alias("listed"), tx.is_appendix_heading(F.col("line")).alias("appendix")).agg(F.count(F.lit(1)).alias("n"))


def section_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short line without a full stop stands for a heading; repeated ones are running headers."""
    lines = _lines(spark, sf_dir)
    title = F.when((F.length("line").between(1, 40)) & ~F.endswith(F.col("line"), F.lit(".")), F.col("line"))
    out = chunking.carry_sections(lines, "doc_id", "line_no", title)
    return out.groupBy("doc_id", F.coalesce("section", F.lit("")).alias("section")).agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", chunking.text_blocks(F.col("text")).alias("blocks"))
    out = chunking.chunk_documents(docs)
    return out.select("doc_id", "chunk_index", "page_number", "end_page_number", "chunk_type", F.length("content").alias("chars"), F.sha2("content", 256).alias("content_sha256"))


def contextual_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    section = F.when(F.col("doc_id") % 3 == 0, "  ").when(F.col("doc_id") % 3 == 1, F.col("lang"))
    return d.select("doc_id", F.sha2(tx.contextual_prefix(F.col("source"), section, F.col("text")), 256).alias("input_sha256"))


def doi_isbn_arxiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers written into sentences by row number, found again and checked."""
    d = table(spark, sf_dir, "documents")
    n = F.lpad(F.col("doc_id").cast("string"), 9, "0")
    sentence = F.concat(F.lit("See (doi:10.1234/AB."), F.col("doc_id").cast("string"), F.lit("). Also arXiv:2301."), F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0"), F.lit("v2 of "), (1990 + F.col("doc_id") % 40).cast("string"), F.lit("."))
    isbn = F.concat(n, F.when(F.col("doc_id") % 11 == 10, "X").otherwise((F.col("doc_id") % 11).cast("string")))
    found = d.select("doc_id", ids.extract_doi(sentence).alias("doi"), ids.arxiv_doi(sentence).alias("arxiv"), ids.first_year(sentence).alias("year"), ids.valid_isbn(isbn).alias("isbn"))
    return found.select("doc_id", ids.normalise_doi(F.concat(F.lit("https://doi.org/"), "doi")).alias("doi"), ids.is_doi(F.col("doi")).alias("is_doi"), "arxiv", "year", "isbn")


def title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    a, b = F.col("text"), F.substring("text", F.lit(20), F.length("text"))
    return d.select("doc_id", F.round(tx.title_similarity(a, b), 6).alias("similarity"), tx.title_matches(a, b).alias("matches"))


def bibtex_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = c.join(n, c.c_nationkey == n.n_nationkey)
    entry = ids.bibtex(F.concat(F.lit("Ann "), "n_name", F.lit(", Bo Lee")), F.concat(F.lit("On "), "c_name"), (1990 + F.col("c_custkey") % 30).cast("int"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("10.1/"), F.col("c_custkey").cast("string"))))
    return rows.select("c_custkey", entry.alias("entry"), ids.safe_file_name(F.concat("c_name", F.lit(" x/y"))).alias("file_name"))


def json_tolerant_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as a model would return them: fenced, with unusable items among the good ones."""
    e = table(spark, sf_dir, "events")
    items = F.concat(F.lit('{"names": [" a ", "", "b"], "indexes": ["1", "x", "3", "1", "9", "'), (F.col("event_id") % 7).cast("string"), F.lit('"], "error": "e'), (F.col("event_id") % 3).cast("string"), F.lit('"}'))
    fenced = F.concat(F.lit("```json\n"), items, F.lit("\n```"))
    p = e.select("event_id", js.tolerant_json(fenced, "names array<string>, indexes array<string>").alias("p"), js.error_message(items).alias("error"))
    return p.select("event_id", F.array_join(js.clean_strings(F.col("p.names"), 5), "|").alias("names"), F.array_join(js.index_list(F.col("p.indexes"), F.lit(5)).cast("array<string>"), ",").alias("indexes"), "error")


def json_nested_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chips of an insight: paper numbers resolved to keys and titles."""
    o = table(spark, sf_dir, "orders")
    refs = F.array(*(F.struct(F.lit(f"p{i}").alias("id"), F.lit(f"Title {i}").alias("title")) for i in range(1, 6)))
    wanted = F.array(*((F.col("o_orderkey") % m + 1).cast("int") for m in (7, 5, 3)))
    chips = F.filter(F.transform(F.array_distinct(wanted), lambda i: F.get(refs, i - 1)), lambda c: c.isNotNull())
    return o.select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("key"), chips.alias("papers"))).alias("payload"))


def conversation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("turn = 0")
    return c.select("conv_id", tx.conversation_title(F.col("text")).alias("title"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", ids.host(F.col("url")).alias("host"), ids.short_id(F.col("url")).alias("short_id"), ids.is_safe_url(F.col("url")).alias("safe"))


def page_range_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    cases = F.array(*(F.lit(x) for x in ("1-3,7", "5", "9-4", "a,2", "2, 2-4")))
    text = F.get(cases, F.col("r_regionkey"))
    return r.select("r_regionkey", F.array_join(ids.expand_ranges(text).cast("array<string>"), ",").alias("pages"))


def quote_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.contained_quotes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def quote_multitier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stretch of each document as a quote, disturbed in a way that depends on the row, found again."""
    d = table(spark, sf_dir, "documents")
    page, piece = F.col("text"), F.substring("text", 40, 120)
    quote = (
        F.when(F.col("doc_id") % 5 == 0, piece).when(F.col("doc_id") % 5 == 1, F.upper(piece)).when(F.col("doc_id") % 5 == 2, F.concat(F.lit("zzqq "), piece, F.lit(" qqzz")))
        .when(F.col("doc_id") % 5 == 3, F.regexp_replace(piece, "e", "3")).otherwise(F.reverse(piece))
    )
    return matching.find_quotes(d.select("doc_id", page.alias("page"), quote.alias("quote")), "doc_id", "page", "quote")


def context_dedup_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of an answer; every third is one of two texts that share all words but one or two of sixty."""
    answer = (F.col("doc_id") / 10).cast("long")
    planted = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " "), F.lit(" Tail"), (F.col("doc_id") % 2).cast("string"))
    d = table(spark, sf_dir, "documents").select("doc_id", answer.alias("answer"), F.when(F.col("doc_id") % 3 == 1, planted).otherwise(F.col("text")).alias("content"))
    return matching.keep_first(d, "answer", "doc_id", "content").select("answer", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (extraction_quality, chunk_quality, block_classify, section_carry_forward, chunk_documents, contextual_prefix, doi_isbn_arxiv, title_similarity, bibtex_export, json_tolerant_parse, json_nested_payload, conversation_titles, url_parts, page_range_expand, quote_containment, quote_multitier, context_dedup_jaccard)
}

_LINES = "SELECT doc_id, unnest(generate_series(0, len(ls)::BIGINT - 1))::INT AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"
_SET = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({0}), '[^a-z0-9 ]', '', 'g'), ' +'), lambda t: t <> ''))"
_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_A, _B = "text", "substr(text, 20)"
SQL = {
    "extraction_quality": r"""WITH c AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(replace(text, '--- PAGE ', ''), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'), '[0-9]+ ---', '', 'g'), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS t FROM documents),
      m AS (SELECT doc_id, text, length(t) AS n, length(regexp_replace(t, '[^\p{L} \t\r\n]', '', 'g'))::DOUBLE / nullif(length(t), 0) AS ratio,
        list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '[ \t\r]', '', 'g')) > 0) AS ls, list_filter(string_split_regex(lower(t), '[ \t\r\n]+'), lambda x: x <> '') AS ws FROM c),
      w AS (SELECT doc_id, text, n, ratio, coalesce((ratio < 0.5)::INT, 0) + coalesce((list_sum(list_transform(ls, lambda x: length(x)))::DOUBLE / len(ls) < 30)::INT, 0) + (len(ws) > 50 AND len(list_distinct(ws))::DOUBLE / len(ws) < 0.2)::INT AS k FROM m),
      s AS (SELECT doc_id, text, CASE WHEN n < 100 THEN 1 ELSE k END::INT AS n_warnings, round(CASE WHEN n < 100 THEN 0 ELSE greatest(0, 1 - k * 0.2::DOUBLE - CASE WHEN ratio < 0.6 THEN 0.3::DOUBLE ELSE 0 END) END, 6) AS score FROM w)
      SELECT doc_id, score, score >= 0.4 AS is_usable, n_warnings, length(trim(regexp_replace(text, '--- PAGE [0-9]+ ---', '', 'g'))) >= 100 AS is_text FROM s""",
    "chunk_quality": rf"""WITH l AS ({_LINES}), s AS (SELECT doc_id, regexp_replace(line, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS s FROM l)
      SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE length(s) >= 50 AND (contains(s, '[TABLE]') OR contains(s, '[FIGURE CAPTION]') OR contains(s, '[TABLE CAPTION]')
        OR (regexp_matches(s, '[.!?]') AND len(string_split_regex(s, '[ \t\r\n]+')) >= 8 AND NOT (length(s) < 80 AND regexp_matches(s, '[0-9]$'))))) AS n_good FROM s GROUP BY 1""",
    "block_classify": rf"""WITH l AS ({_LINES})
      SELECT CASE WHEN regexp_matches(trim(line), '^[0-9]{{1,4}}$') THEN 'none' WHEN regexp_matches(line, '^#{{1,6}} ') THEN 'heading' WHEN regexp_matches(line, '^[ ]*\|.*\|[ ]*$') THEN 'table'
        WHEN regexp_matches(line, '^(\$\$|\\\[)') THEN 'equation' WHEN regexp_matches(line, '^(```|    )') THEN 'code' WHEN regexp_matches(trim(line), '^(?i)(figure|fig\.?|table|tab\.?)\s*[0-9]+[.:)\-\s]') THEN 'caption'
        WHEN trim(line) <> '' THEN 'paragraph' ELSE 'none' END AS kind,
        regexp_matches(trim(line), '^([-•*][ \t]|[0-9]+[.)][ \t])') AS listed,
        regexp_matches(lower(trim(line)), '^(appendix|supplementary)') OR regexp_matches(trim(line), '^\(?[A-Z]\)?\.?[ \t]+[^ \t]') AS appendix, count(*) AS n FROM l GROUP BY 1, 2, 3""",
    "section_carry_forward": f"""WITH l AS ({_LINES}), t AS (SELECT *, CASE WHEN length(line) BETWEEN 1 AND 40 AND NOT ends_with(line, '.') THEN line END AS title FROM l),
      k AS (SELECT *, CASE WHEN count(title) OVER (PARTITION BY doc_id, title) <= 3 THEN title END AS kept FROM t),
      s AS (SELECT *, last_value(kept IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM k)
      SELECT doc_id, coalesce(section, '') AS section, count(*) AS n, min(line_no) AS first_line FROM s GROUP BY 1, 2""",
    "contextual_prefix": """SELECT doc_id, sha256('Paper: ' || coalesce(nullif(trim(source), ''), '(untitled)') || chr(10) || 'Section: ' || CASE WHEN doc_id % 3 = 1 THEN lang ELSE '(untitled)' END || chr(10) || chr(10) || text) AS input_sha256 FROM documents""",
    "doi_isbn_arxiv": """WITH i AS (SELECT doc_id, lpad(doc_id::VARCHAR, 9, '0') AS n, doc_id % 11 AS c FROM documents),
      k AS (SELECT *, list_sum(list_transform(generate_series(1, 9), lambda j: (11 - j)::BIGINT * substr(n, j::INT, 1)::INT)) + c AS total FROM i)
      SELECT doc_id, '10.1234/ab.' || doc_id AS doi, true AS is_doi, '10.48550/arxiv.2301.' || lpad((doc_id % 100000)::VARCHAR, 5, '0') AS arxiv, (1990 + doc_id % 40)::INT AS year,
        CASE WHEN total % 11 = 0 THEN n || CASE WHEN c = 10 THEN 'X' ELSE c::VARCHAR END END AS isbn FROM k""",
    "title_similarity": f"""WITH s AS (SELECT doc_id, {_SET.format(_A)} AS a, {_SET.format(_B)} AS b, {_NORM.format(_A)} AS c, {_NORM.format(_B)} AS t FROM documents),
      i AS (SELECT *, len(list_intersect(a, b)) AS n, list_distinct(string_split(c, ' ')) AS cw, list_distinct(string_split(t, ' ')) AS tw FROM s)
      SELECT doc_id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(n::DOUBLE / (len(a) + len(b) - n), 6) ELSE 0 END::DOUBLE AS similarity,
        c <> '' AND t <> '' AND (contains(t, c) OR contains(c, t) OR len(list_intersect(cw, tw)) * 2 >= len(cw)) AS matches FROM i""",
    "bibtex_export": """SELECT c_custkey, '@article{' || lower(n_last) || y || ',' || chr(10) || '  title = {On ' || c_name || '},' || chr(10) || '  author = {Ann ' || n_name || ', Bo Lee},' || chr(10) || '  year = {' || y || '}'
        || CASE WHEN c_custkey % 2 = 0 THEN ',' || chr(10) || '  doi = {10.1/' || c_custkey || '}' ELSE '' END || chr(10) || '}' AS entry, regexp_replace(c_name || ' x/y', '[^A-Za-z0-9._-]+', '_', 'g') AS file_name
      FROM (SELECT *, 1990 + c_custkey % 30 AS y, string_split_regex('Ann ' || n_name, ' +')[-1] AS n_last FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "json_tolerant_parse": """SELECT event_id, 'a|b' AS names, CASE WHEN event_id % 7 IN (2, 4, 5) THEN '1,3,' || (event_id % 7) ELSE '1,3' END AS indexes, 'e' || (event_id % 3) AS error FROM events""",
    "json_nested_payload": """WITH w AS (SELECT o_orderkey, unnest([o_orderkey % 7 + 1, o_orderkey % 5 + 1, o_orderkey % 3 + 1]) AS i, unnest([1, 2, 3]) AS k FROM orders),
      f AS (SELECT o_orderkey, i, min(k) AS k FROM w WHERE i <= 5 GROUP BY 1, 2)
      SELECT o_orderkey, '{"key":' || o_orderkey || ',"papers":[' || string_agg('{"id":"p' || i || '","title":"Title ' || i || '"}', ',' ORDER BY k) || ']}' AS payload FROM f GROUP BY 1""",
    "conversation_titles": "SELECT conv_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '…' ELSE text END AS title FROM conversations WHERE turn = 0",
    "url_parts": r"""WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)) AS h FROM pages)
      SELECT page_id, regexp_replace(nullif(h, ''), '^www\.', '') AS host, string_split(url, '/')[-1] AS short_id, regexp_matches(url, '^(?i)https?://') AND h <> '' AND NOT
        regexp_matches(h, '^(localhost|.*\.local|.*\.internal|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|0\..*|\[?::1\]?)$') AS safe FROM h""",
    "page_range_expand": "SELECT r_regionkey, ['1,2,3,7', '5', NULL, NULL, '2,3,4'][r_regionkey + 1] AS pages FROM region",
    "context_dedup_jaccard": r"""WITH RECURSIVE d AS (SELECT doc_id, doc_id // 10 AS answer, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY doc_id // 10) AS n,
        list_distinct(list_filter(string_split_regex(lower(coalesce(CASE WHEN doc_id % 3 = 1 THEN array_to_string(list_transform(generate_series(1, 60), lambda i: 'w' || i), ' ') || ' Tail' || doc_id % 2 ELSE text END, '')), '\s+'), lambda x: x <> '')) AS ws FROM documents),
      p AS (SELECT b.doc_id AS later, list(a.doc_id) AS near FROM d a JOIN d b ON a.answer = b.answer AND a.k < b.k
        WHERE len(list_intersect(a.ws, b.ws)) > 0.9::DOUBLE * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) GROUP BY 1),
      r AS (SELECT answer, 0::BIGINT AS k, []::BIGINT[] AS kept FROM d WHERE k = 1 UNION ALL
        SELECT r.answer, d.k, CASE WHEN n = 1 OR (len(ws) > 0 AND NOT list_has_any(kept, coalesce(near, []))) THEN list_append(kept, d.doc_id) ELSE kept END
        FROM r JOIN d ON d.answer = r.answer AND d.k = r.k + 1 LEFT JOIN p ON later = d.doc_id)
      SELECT answer, unnest(kept) AS doc_id FROM (SELECT *, row_number() OVER (PARTITION BY answer ORDER BY k DESC) AS z FROM r) WHERE z = 1""",
    "quote_containment": r"""WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g')) AS t FROM documents), q AS (SELECT item_id, trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g')) AS q FROM benchmark WHERE length(text) >= 10)
      SELECT doc_id, item_id FROM d JOIN q ON contains(t, q)""",
}
