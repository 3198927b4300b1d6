"""Library analytics: overview, comparison, recommendations, listing, duplicates, trees, annotations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard, written


def _near_pairs(least: float, limit: int):
    """The best ``limit`` pairs of each cell by one matrix product: a block's inner pairs, or those across its two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)  # the cells of one task, a few blocks
        if not rows.num_rows:
            return
        cell, own, other, ids = (rows.column(c).to_numpy() for c in ("cell", "own", "other", "id"))
        vectors = pc.list_flatten(rows.column("unit")).to_numpy().reshape(rows.num_rows, -1)
        order = np.argsort(cell, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            inner = (own[part] == other[part]).all()
            first = own[part] == own[part].min()
            left, right = (part, part) if inner else (part[first], part[~first])
            score = vectors[left] @ vectors[right].T
            near = score >= least - 1e-6
            if inner:
                near &= ids[left][:, None] < ids[right][None, :]
            a, b = np.nonzero(near)
            low, high, score = np.minimum(ids[left[a]], ids[right[b]]), np.maximum(ids[left[a]], ids[right[b]]), score[a, b]
            best = np.lexsort((high, low, -np.round(score, 6)))[:limit]
            yield pa.RecordBatch.from_arrays([pa.array(x[best]) for x in (np.full(len(a), cell[part[0]]), low, high, score)], names=["cell", "id_a", "id_b", "similarity"])

    return run


def near_duplicate_pairs(rows: DataFrame, group: str, key: str, vector: str, least: float, limit: int, block: int = 1024) -> DataFrame:
    """Pairs inside a group whose cosine is ``least`` or more, each once, the best ``limit``.

    A group is dealt out as pairs of blocks of about ``block`` rows, each compared in one task by a matrix product, so a hot group
    spreads over many tasks and only the best pairs of each cell are written.  Keys are whole numbers and distinct.
    """
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    units = rows.where(F.col(vector).isNotNull()).select(group, F.col(key).alias("id"), F.col(vector).alias("v"), norm.alias("norm")).where("norm > 0")
    sizes = units.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = units.join(sizes, group).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select(F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "own", "other", "id", F.transform("v", lambda x: x.cast("double") / F.col("norm")).alias("unit"))
    found = cells.repartition("cell").mapInArrow(_near_pairs(least, limit), "cell long, id_a long, id_b long, similarity double")
    named = found.join(units.select(F.col("id").alias("id_a"), group), "id_a")
    pairs = named.withColumn("similarity", F.round("similarity", 6)).where(F.col("similarity") >= least)
    return pairs.orderBy(F.desc("similarity"), "id_a", "id_b").limit(limit).select(group, "id_a", "id_b", "similarity")


def list_library(rows: DataFrame, *, search: str | None = None, title: str = "title", sort: str = "-created", allowed: dict[str, str], key: str, offset: int = 0, limit: int = 20) -> DataFrame:
    """Contains-filter, whitelisted sort (``-`` for descending, nulls as the database places them), page."""
    name = sort.lstrip("-")
    if name not in allowed:
        raise ValueError(f"unknown sort column: {name}")
    if search:
        rows = rows.where(F.col(title).ilike(f"%{search}%"))
    column = F.col(allowed[name])
    order = column.desc_nulls_first() if sort.startswith("-") else column.asc_nulls_last()
    return rows.orderBy(order, F.asc(key)).offset(offset).limit(limit)


def reference_counts(refs: DataFrame, paper: str, work: str, members: DataFrame, least: int = 2, limit: int = 10) -> DataFrame:
    """Works that members cite and that are no members: count of citations, ``least`` or more, the best ``limit``."""
    outside = refs.join(members.select(F.col("member").alias(work)), work, "left_anti")
    return outside.groupBy(work).agg(F.count(F.lit(1)).alias("citations")).where(F.col("citations") >= least).orderBy(F.desc("citations"), F.asc(work)).limit(limit)


def name_counts(rows: DataFrame, names: str, limit: int = 10) -> DataFrame:
    """Most frequent names of a comma list; a list that writes the surname first counts as two names."""
    split = rows.select(F.explode(F.split(names, ",")).alias("name")).select(F.trim("name").alias("name")).where("name <> ''")
    return split.groupBy("name").count().withColumnRenamed("count", "n").orderBy(F.desc("n"), "name").limit(limit)


def tree_closure(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """All (ancestor, node, depth) of an adjacency list (node, parent), the shortest depth of each pair.

    Paths double: pairs up to depth d and pairs of just d make all up to 2 d, so the rounds follow the logarithm of
    the depth and each is a written table.  Circles end where no pair is new; a node in one is its own ancestor.
    """
    closure = written(edges.where("parent is not null").select(F.col("parent").alias("ancestor"), "node", F.lit(1).cast("long").alias("depth")).distinct(), "closure")
    reach, pairs = 1, closure.count()
    while pairs:
        far = closure.where(F.col("depth") == reach).select("node", F.col("ancestor").alias("middle"), "depth")
        near = closure.select("ancestor", F.col("node").alias("middle"), F.col("depth").alias("more"))
        longer = far.join(near, "middle").select("ancestor", "node", (F.col("depth") + F.col("more")).alias("depth"))
        both = written(closure.unionByName(longer).groupBy("ancestor", "node").agg(F.min("depth").alias("depth")), "closure")
        found = both.count()
        discard(closure)
        closure, reach = both, 2 * reach
        if found == pairs:
            break
        pairs = found
    return closure


def tree_levels(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root, depth) of every node of an adjacency list with one parent a node; nodes that lead into a circle have no root.

    Pointers double: each round a node's pointer takes over that of the node it points to, so the rounds follow the logarithm
    of the depth and a round moves one row a node.
    """
    kind = edges.schema["parent"].dataType
    own = edges.select("node", "parent").unionByName(edges.where("parent is not null").select(F.col("parent").alias("node"), F.lit(None).cast(kind).alias("parent")))
    parents = own.groupBy("node").agg(F.max("parent").alias("up"))
    jump = written(parents.select("node", "up", F.when(F.col("up").isNull(), F.col("node")).alias("root"), F.when(F.col("up").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("depth")), "levels")
    nodes, reach = jump.count(), 1
    while reach < nodes and jump.where("root is null").limit(1).count():
        further = jump.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("root").alias("top"), F.col("depth").alias("more"))
        moved = jump.where("root is null").join(further, "up").select("node", F.col("next").alias("up"), F.col("top").alias("root"), (F.col("depth") + F.col("more")).alias("depth"))
        both = written(jump.where("root is not null").unionByName(moved), "levels")
        discard(jump)
        jump, reach = both, 2 * reach
    return jump.select("node", "root", F.when(F.col("root").isNotNull(), F.col("depth")).alias("depth"))


def makes_cycle(spark: SparkSession, edges: DataFrame, node, new_parent) -> bool:
    """Whether putting ``node`` under ``new_parent`` closes a circle: whether it is among the new parent's ancestors.

    The known ancestors double each round, by pointers of twice the length, so nothing but one node's way up is kept.
    """
    if node == new_parent:
        return True
    jump = edges.where("parent is not null").select("node", "parent")
    found, known = spark.range(1).select(F.lit(new_parent).cast(edges.schema["node"].dataType).alias("at")), 1
    while True:
        found = written(found.unionByName(found.join(jump, F.col("at") == F.col("node")).select(F.col("parent").alias("at"))).distinct(), "ancestors")
        if found.where(F.col("at") == node).limit(1).count():
            return True
        now = found.count()
        if now == known:
            return False
        known = now
        further = jump.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        jump = written(jump.join(further, "parent").select("node", F.col("next").alias("parent")), "jumps")


def shared_view(shares: DataFrame, sets: DataFrame, notes: DataFrame, pdfs: DataFrame, users: DataFrame) -> DataFrame:
    """What each share's link shows: a row for every annotation of its set, one without a note where the set is empty.

    ``shares`` (token, set_id, shared_by, permission), ``sets`` (set_id, pdf_id, color), ``notes`` (set_id, turn, note), ``pdfs`` (pdf_id,
    title), ``users`` (user_id, display_name, login).  Notes are shown to those who may comment; a paper or a sharer that is
    gone is named as unknown, and a set without a colour has the default one.
    """
    opened = shares.join(sets, "set_id").join(pdfs, "pdf_id", "left").join(users, F.col("shared_by") == F.col("user_id"), "left").join(notes, "set_id", "left")
    return opened.select(
        "token", "set_id", "pdf_id", F.coalesce("title", F.lit("Unknown PDF")).alias("pdf_title"), "permission", F.coalesce("color", F.lit("#FFFF00")).alias("color"),
        F.coalesce(F.nullif("display_name", F.lit("")), F.nullif("login", F.lit("")), F.lit("Unknown")).alias("shared_by"), "turn", F.when(F.col("permission") == "comment", F.col("note")).alias("note"),
    )


def swap_positions(rows: DataFrame, key: str, position: str, a, b) -> DataFrame:
    """Two siblings change places."""
    at = {r[key]: r[position] for r in rows.where(F.col(key).isin(a, b)).select(key, position).collect()}
    return rows.withColumn(position, F.when(F.col(key) == a, at.get(b)).when(F.col(key) == b, at.get(a)).otherwise(F.col(position)))


def reparent_children(rows: DataFrame, key: str, parent: str, gone) -> DataFrame:
    """Delete a node; its children go to its parent."""
    grand = rows.where(F.col(key) == gone).select(F.col(parent).alias("__grand"))
    moved = rows.where(F.col(key) != gone).join(F.broadcast(grand.limit(1)), F.col(parent) == gone, "left")
    return moved.withColumn(parent, F.when(F.col(parent) == gone, F.col("__grand")).otherwise(F.col(parent))).drop("__grand")


def page_colour_groups(rows: DataFrame, page: str, colour: str, default: str) -> DataFrame:
    """Annotations of each page with the count of each colour."""
    tinted = rows.withColumn("colour", F.coalesce(colour, F.lit(default)))
    return tinted.groupBy(page, "colour").agg(F.count(F.lit(1)).alias("n"))


def last_n(rows: DataFrame, group: str, order: Column, n: int, tie: str) -> DataFrame:
    newest = Window.partitionBy(group).orderBy(order.desc(), F.desc(tie))
    return rows.withColumn("__k", F.row_number().over(newest)).where(F.col("__k") <= n).drop("__k")


def merge_intervals(rows: DataFrame, group: str, low: str, high: str) -> DataFrame:
    """Intervals of a group that touch or overlap become one: (group, low, high, n)."""
    order = Window.partitionBy(group).orderBy(low, high)
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.withColumn("fresh", F.when(reach.isNull() | (F.col(low) > reach), 1).otherwise(0))
    islands = starts.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(group, "island").agg(F.min(low).alias("low"), F.max(high).alias("high"), F.count(F.lit(1)).alias("n")).drop("island")


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, upper_median, lower_median) from counts of each value, so a key's rows are added up before they meet."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(key).orderBy(value)
    placed = counts.withColumn("end", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(key)))

    def value_at(place: Column) -> Column:
        return F.max(F.when((F.col("end") > place) & (F.col("end") - F.col("n") <= place), F.col(value)))

    return placed.groupBy(key).agg(value_at(F.floor(F.col("total") / 2)).alias("upper_median"), value_at(F.floor((F.col("total") - 1) / 2)).alias("lower_median"))
