"""Queries of library analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dml, library
from ..sources.tables import table


def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    groups = docs.groupBy(F.sha2("text", 256).alias("text_sha256")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return groups.where("n > 1")


def list_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("lang = 'en'")
    page = library.list_library(rows, search="The", title="text", sort="-file_size", allowed={"file_size": "n_chars", "id": "doc_id"}, key="doc_id", offset=20, limit=20)
    return page.select("doc_id", "source", "n_chars")


def collection_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members, labelled members and good ones of each collection."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.select("doc_id", "source", "lang").join(labels, "doc_id", "left")
    return joined.groupBy("source").agg(
        F.count("doc_id").alias("papers"), F.count("quality").alias("indexed"), F.count(F.when(F.col("quality") == 1, 1)).alias("good"), F.countDistinct("lang").alias("languages")
    )


def top_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).select(F.concat_ws(", ", "n_name", "c_mktsegment", F.lit(" ")).alias("authors"))
    return library.name_counts(rows, "authors", 10)


def comparison_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id", "left").where("source = 'src1'")
    return rows.orderBy(F.asc_nulls_last("quality"), F.lower("lang"), "doc_id").limit(50).select("doc_id", "lang", "quality", (F.coalesce("quality", F.lit(0)) != 1).alias("missing"))


def missing_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.select("doc_id", "source").join(labels.select("doc_id", "quality"), "doc_id", "left")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count("quality").alias("cited"), F.count(F.when(F.col("quality").isNull(), 1)).alias("missing"))


def cocitation_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order cites the parts on its lines; parts that at least two member orders cite and that are no members."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("work"))
    members = table(spark, sf_dir, "part").where("p_size <= 7").select(F.col("p_partkey").alias("member"))
    return library.reference_counts(lines, "l_orderkey", "work", members)


def reference_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    refs = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("refs"))
    joined = o.join(refs, o.o_orderkey == refs.l_orderkey, "left")
    return joined.agg(F.count(F.lit(1)).alias("papers_total"), F.count("refs").alias("with_refs"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("without_doi"))


def recent_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(5).select("o_orderkey", "o_custkey", "o_totalprice")


def timeline_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("year", F.when(F.col("o_orderkey") % 50 != 0, F.year("o_orderdate")))
    return o.groupBy("year").agg(F.count(F.lit(1)).alias("papers")).orderBy(F.desc_nulls_last("year"))


def page_color_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 25).alias("page"), F.when(F.col("user_id") % 3 != 0, F.col("event_type")).alias("colour"))
    return library.page_colour_groups(e, "page", "colour", "yellow")


def share_permission_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared annotations: notes only for those who may comment."""
    c = table(spark, sf_dir, "conversations")
    perm = F.when(F.col("conv_id") % 2 == 0, "comment").otherwise("view")
    return c.select("conv_id", "turn", perm.alias("permission"), F.when(perm == "comment", F.col("text")).alias("note_content"))


def outer_filtered_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    right = o.where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    return c.join(right, c.c_custkey == right.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("urgent"))


def semi_anti_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    have, lack = c.join(o, "c_custkey", "left_semi"), c.join(o, "c_custkey", "left_anti")
    return have.withColumn("member", F.lit(True)).unionByName(lack.withColumn("member", F.lit(False))).groupBy("c_mktsegment", "member").agg(F.count(F.lit(1)).alias("n"))


def band_join_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations within two pages of each page number, per user: the band is an equality on shifted pages, so it hashes."""
    e = table(spark, sf_dir, "events")
    pages = e.groupBy("user_id", (F.col("event_id") % 40).alias("page")).agg(F.count(F.lit(1)).alias("n"))
    reach = pages.select("user_id", F.explode(F.array(*(F.col("page") + d for d in range(-2, 3)))).alias("page"), F.col("n").alias("near"))
    return pages.join(reach, ["user_id", "page"]).groupBy("user_id", "page").agg(F.sum("near").alias("within_two"))


def tree_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation and customer groups as one tree of names."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    regions = r.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("root").alias("parent"))
    nations = n.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return library.tree_closure(spark, regions.unionByName(nations))


def tree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions as a deep forest: a document follows the one before it, every thousandth starts anew."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), F.when(F.col("doc_id") % 1000 != 0, F.col("doc_id") - 1).alias("parent"))
    return library.tree_levels(spark, d)


def reparent_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") > 0, (F.col("n_nationkey") / 3).cast("int")).alias("parent_id"), (F.col("n_nationkey") % 3).alias("position"))
    moved = library.reparent_children(n, "id", "parent_id", 2)
    return library.swap_positions(moved, "id", "position", 4, 5)


def history_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return library.last_n(c, "conv_id", F.col("turn"), 3, "role").select("conv_id", "turn", "role")


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    return dml.upsert(dml.latest(old, ["user_id", "event_type"], "event_id"), dml.latest(new, ["user_id", "event_type"], "event_id"), ["user_id", "event_type"])


def insert_if_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct().withColumn("origin", F.lit("orders"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).withColumn("origin", F.lit("customer"))
    return dml.insert_missing(o, c, ["id"])


def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, li = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    gone = c.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    orders = o.join(gone, "o_custkey", "left_anti")
    lines = li.join(o.join(gone, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti")
    return orders.agg(F.count(F.lit(1)).alias("n")).select(F.lit("orders").alias("tab"), "n").unionByName(lines.agg(F.count(F.lit(1)).alias("n")).select(F.lit("lineitem").alias("tab"), "n"))


def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.unix_timestamp("ts").alias("low")).withColumn("high", F.col("low") + 6 * 3600)
    return library.merge_intervals(e, "user_id", "low", "high")


def running_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tops of stacked pages (heights and a gap of 16), and which of them a scroll window shows."""
    from pyspark.sql import Window

    before = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    d = table(spark, sf_dir, "documents").select("source", "doc_id", (F.col("n_chars") % 500 + 300).alias("height"))
    laid = d.withColumn("top", F.coalesce(F.sum(F.col("height") + 16).over(before), F.lit(0)))
    return laid.withColumn("visible", (F.col("top") < 3000) & (F.col("top") + F.col("height") > 1000))


def rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))

    def mean(rows: int):
        """Whole cents add up exactly in any order."""
        frame = w.rowsBetween(1 - rows, 0)
        return F.sum("cents").over(frame) / F.count("cents").over(frame) / 100

    return e.select("user_id", "event_id", mean(60).alias("mean_60"), mean(600).alias("mean_600"))


def median_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper and lower medians: the middle values of the sorted list, not their mean."""
    return library.medians(table(spark, sf_dir, "lineitem"), "l_partkey", "l_quantity")


def label_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default colour labels overlaid with a user's own."""
    defaults = F.create_map(*(F.lit(x) for x in ("click", "red", "view", "blue", "purchase", "green")))
    own = F.create_map(F.col("event_type"), F.concat(F.lit("own-"), (F.col("user_id") % 3).cast("string")))
    e = table(spark, sf_dir, "events").withColumn("labels", F.map_zip_with(defaults, own, lambda k, d, o: F.coalesce(o, d)))
    return e.select("event_id", F.coalesce(F.try_element_at("labels", F.lit("click")), F.lit("grey")).alias("click_label"), F.size("labels").alias("n_labels"))


def library_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a new selection adds to and takes from an old one, per order."""
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey"))).alias("old"), F.collect_set(F.when(F.col("l_linenumber") % 3 != 0, F.col("l_partkey"))).alias("new"))
    return g.select("l_orderkey", F.size(F.array_except("new", "old")).alias("to_add"), F.size(F.array_except("old", "new")).alias("to_remove"), F.size(F.array_intersect("old", "new")).alias("kept"))


QUERIES = {
    f.__name__: f
    for f in (exact_duplicate_groups, list_library, collection_overview, top_authors, comparison_matrix, missing_citations, cocitation_recommend, reference_coverage, recent_additions, timeline_by_year, page_color_groups, share_permission_view, outer_filtered_on, semi_anti_membership, band_join_pages, tree_closure, tree_levels, reparent_swap, history_last_n, upsert_latest, insert_if_missing, unique_violations, cascade_delete, merge_intervals, running_layout, rolling_mean, median_filter, label_overlay, library_set_difference)
}

SQL = {
    "exact_duplicate_groups": "SELECT sha256(text) AS text_sha256, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "list_library": "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND text ILIKE '%The%' ORDER BY n_chars DESC NULLS FIRST, doc_id LIMIT 20 OFFSET 20",
    "collection_overview": "SELECT source, count(d.doc_id) AS papers, count(quality) AS indexed, count(*) FILTER (WHERE quality = 1) AS good, count(DISTINCT lang) AS languages FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source",
    "top_authors": """SELECT name, count(*) AS n FROM (SELECT trim(unnest(string_split(n_name || ', ' || c_mktsegment || ',  ', ','))) AS name FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE name <> ''
      GROUP BY name ORDER BY n DESC, name LIMIT 10""",
    "comparison_matrix": """SELECT doc_id, lang, quality, coalesce(quality, 0) <> 1 AS missing FROM documents LEFT JOIN labels USING (doc_id) WHERE source = 'src1'
      ORDER BY quality ASC NULLS LAST, lower(lang), doc_id LIMIT 50""",
    "missing_citations": "SELECT source, count(*) AS total, count(quality) AS cited, count(*) FILTER (WHERE quality IS NULL) AS missing FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
    "cocitation_recommend": """SELECT l_partkey AS work, count(*) AS citations FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 7)
      GROUP BY 1 HAVING count(*) >= 2 ORDER BY citations DESC, work LIMIT 10""",
    "reference_coverage": """SELECT count(*) AS papers_total, count(refs) AS with_refs, count(*) FILTER (WHERE o_orderstatus = 'F') AS without_doi
      FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS refs FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
    "recent_additions": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5",
    "timeline_by_year": "SELECT (CASE WHEN o_orderkey % 50 <> 0 THEN year(o_orderdate) END)::INT AS year, count(*) AS papers FROM orders GROUP BY 1",
    "page_color_groups": "SELECT event_id % 25 AS page, coalesce(CASE WHEN user_id % 3 <> 0 THEN event_type END, 'yellow') AS colour, count(*) AS n FROM events GROUP BY 1, 2",
    "share_permission_view": "SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'comment' ELSE 'view' END AS permission, CASE WHEN conv_id % 2 = 0 THEN text END AS note_content FROM conversations",
    "outer_filtered_on": "SELECT c_custkey, count(o_orderkey) AS urgent FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1",
    "semi_anti_membership": "SELECT c_mktsegment, c_custkey IN (SELECT o_custkey FROM orders) AS member, count(*) AS n FROM customer GROUP BY 1, 2",
    "band_join_pages": """WITH p AS (SELECT user_id, event_id % 40 AS page, count(*) AS n FROM events GROUP BY 1, 2)
      SELECT a.user_id, a.page, sum(b.n)::BIGINT AS within_two FROM p a JOIN p b ON a.user_id = b.user_id AND abs(a.page - b.page) <= 2 GROUP BY 1, 2""",
    "tree_levels": """WITH RECURSIVE t AS (SELECT doc_id AS node, doc_id AS root, 0::BIGINT AS depth FROM documents WHERE doc_id % 1000 = 0
      UNION ALL SELECT doc_id, root, depth + 1 FROM t JOIN documents ON doc_id = node + 1 AND doc_id % 1000 <> 0) SELECT * FROM t""",
    "tree_closure": """WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS node, 'root' AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
      t AS (SELECT parent AS ancestor, node, 1::BIGINT AS depth FROM e UNION ALL SELECT e.parent, t.node, t.depth + 1 FROM t JOIN e ON e.node = t.ancestor)
      SELECT ancestor, node, depth FROM t""",
    "reparent_swap": """WITH n AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey > 0 THEN n_nationkey // 3 END AS parent_id, n_nationkey % 3 AS position FROM nation)
      SELECT id, CASE WHEN parent_id = 2 THEN (SELECT parent_id FROM n WHERE id = 2) ELSE parent_id END AS parent_id,
        CASE id WHEN 4 THEN (SELECT position FROM n WHERE id = 5) WHEN 5 THEN (SELECT position FROM n WHERE id = 4) ELSE position END AS position FROM n WHERE id <> 2""",
    "history_last_n": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS k FROM conversations) WHERE k <= 3",
    "upsert_latest": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 2 DESC, event_id DESC) AS k FROM events)
      SELECT user_id, event_type, value, event_id FROM r WHERE k = 1""",
    "insert_if_missing": """SELECT DISTINCT o_custkey AS id, 'orders' AS origin FROM orders
      UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
    "unique_violations": "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "cascade_delete": """WITH g AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
      SELECT 'orders' AS tab, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT * FROM g)
      UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM g))""",
    "merge_intervals": """WITH e AS (SELECT user_id, epoch(ts)::BIGINT AS low, epoch(ts)::BIGINT + 21600 AS high FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events)),
      s AS (SELECT *, max(high) OVER (PARTITION BY user_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
      i AS (SELECT *, sum((reach IS NULL OR low > reach)::INT) OVER (PARTITION BY user_id ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS island FROM s)
      SELECT user_id, min(low) AS low, max(high) AS high, count(*) AS n FROM i GROUP BY user_id, island""",
    "running_layout": """WITH d AS (SELECT source, doc_id, n_chars % 500 + 300 AS height FROM documents),
      t AS (SELECT *, coalesce(sum(height + 16) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS top FROM d)
      SELECT *, top < 3000 AND top + height > 1000 AS visible FROM t""",
    "rolling_mean": """WITH e AS (SELECT *, round(value * 100)::BIGINT AS cents FROM events)
      SELECT user_id, event_id, sum(cents) OVER a / count(cents) OVER a / 100 AS mean_60, sum(cents) OVER b / count(cents) OVER b / 100 AS mean_600 FROM e
      WINDOW a AS (PARTITION BY user_id ORDER BY event_id ROWS 59 PRECEDING), b AS (PARTITION BY user_id ORDER BY event_id ROWS 599 PRECEDING)""",
    "median_filter": "SELECT l_partkey, a[len(a) // 2 + 1] AS upper_median, a[(len(a) - 1) // 2 + 1] AS lower_median FROM (SELECT l_partkey, list_sort(list(l_quantity)) AS a FROM lineitem GROUP BY 1)",
    "label_overlay": """SELECT event_id, CASE WHEN event_type = 'click' THEN 'own-' || (user_id % 3) ELSE 'red' END AS click_label, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 3 ELSE 4 END AS n_labels
      FROM events""",
    "library_set_difference": """WITH g AS (SELECT l_orderkey, l_partkey, bool_or(l_linenumber % 2 = 0) AS o, bool_or(l_linenumber % 3 <> 0) AS n FROM lineitem GROUP BY 1, 2)
      SELECT l_orderkey, count(*) FILTER (WHERE n AND NOT o)::INT AS to_add, count(*) FILTER (WHERE o AND NOT n)::INT AS to_remove, count(*) FILTER (WHERE o AND n)::INT AS kept FROM g GROUP BY 1""",
}
