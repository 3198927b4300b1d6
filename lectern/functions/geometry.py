"""Rectangles in page shares (x, y, w, h from 0 to 1) and page layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def rotated(r: Column, angle: Column) -> Column:
    """A rectangle of the unrotated page as it lies on the page turned by a multiple of 90 degrees."""
    turn = F.pmod(F.pmod(angle, F.lit(360)) + 360, F.lit(360))
    return (
        F.when(turn == 90, rect(1 - r["y"] - r["h"], r["x"], r["h"], r["w"]))
        .when(turn == 180, rect(1 - r["x"] - r["w"], 1 - r["y"] - r["h"], r["w"], r["h"]))
        .when(turn == 270, rect(r["y"], 1 - r["x"] - r["w"], r["h"], r["w"]))
        .otherwise(rect(r["x"], r["y"], r["w"], r["h"]))
    )


def unrotated(r: Column, angle: Column) -> Column:
    return rotated(r, F.lit(360) - F.pmod(angle, F.lit(360)))


def first_position(rects: Column) -> Column:
    """Top-most rectangle's place (y, then x); what a list of annotations is ordered by."""
    return F.array_min(F.transform(rects, lambda r: F.struct(r["y"].alias("y"), r["x"].alias("x"))))


def merge_line_rects(rows: DataFrame, group: str, x: str, y: str, w: str, h: str) -> DataFrame:
    """Rectangles of one line (same y and h) whose gap is small become one."""
    line = Window.partitionBy(group, y, h).orderBy(x)
    reach = F.max(F.col(x) + F.col(w)).over(line.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.greatest(F.lit(0.005), F.col(h) * 4)
    fresh = rows.withColumn("__new", F.when(reach.isNull() | (F.col(x) > reach + gap), 1).otherwise(0))
    runs = fresh.withColumn("__run", F.sum("__new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(group, y, h, "__run").agg(F.min(x).alias(x), F.max(F.col(x) + F.col(w)).alias("right")).select(group, x, y, (F.col("right") - F.col(x)).alias(w), h)


def range_rects(ranges: DataFrame, items: DataFrame, pages: DataFrame, key: str = "range_id", least: float = 0.0) -> DataFrame:
    """(range, page, rects) of character ranges of page texts: each item that a range meets gives its share of the item's box.

    ``ranges`` has (key, page, from, to); ``items`` (page, start, end, str, transform, width, height) with the place of each text item in
    the page's text, its affine transform and its size; ``pages`` (page, page_width, page_height, rotation).  Blanks at an
    item's ends are not covered, boxes of one line are merged, and the page's rotation is applied last.  Rectangles not over
    ``least`` in both sizes fall away, and ranges that keep none too.
    """
    met = ranges.join(items, "page").where((F.col("start") < F.col("to")) & (F.col("end") > F.col("from"))).join(pages, "page")
    n = F.length("str")
    low, high = F.greatest(F.lit(0), F.col("from") - F.col("start")), F.least(n, F.col("to") - F.col("start"))
    bare_from = n - F.length(F.regexp_replace("str", r"^\s+", ""))
    bare_to = F.length(F.regexp_replace("str", r"\s+$", ""))
    first = F.when(low == 0, F.greatest(low, bare_from)).otherwise(low)
    last = F.when(high == n, F.least(high, bare_to)).otherwise(high)
    t = lambda i: F.col("transform")[i]
    placed = met.select(
        key, "page", "page_width", "page_height", "rotation", "width", n.alias("n"), first.alias("first"), last.alias("last"), t(0).alias("a"), t(1).alias("b"), t(4).alias("left"), t(5).alias("base"),
        F.sqrt(t(0) * t(0) + t(1) * t(1)).alias("along"), F.sqrt(t(2) * t(2) + t(3) * t(3)).alias("across"), "height",
    ).where("first < last and along > 0 and across > 0 and page_width > 0 and page_height > 0")
    tall = F.coalesce(F.nullif(F.col("height"), F.lit(0.0)), F.col("across"))
    boxes = placed.select(
        key, "page", "rotation",
        ((F.col("left") + F.col("first") / F.col("n") * F.col("width") * F.col("a") / F.col("along")) / F.col("page_width")).alias("x"),
        ((F.col("page_height") - F.col("base") - tall) / F.col("page_height")).alias("y"),
        ((F.col("last") - F.col("first")) / F.col("n") * F.abs("width") / F.col("page_width")).alias("w"),
        (tall / F.col("page_height")).alias("h"),
    ).where("w > 0 and h > 0")
    # heights and tops of one line differ by rounding alone
    lined = boxes.withColumn("line", F.struct(F.col(key).alias("of"), F.col("page").alias("page"), F.col("rotation").alias("rotation"), F.round(F.col("y") * 5000).alias("top"), F.round(F.col("h") * 5000).alias("tall")))
    tops = lined.groupBy("line").agg(F.min("y").alias("y"), F.min("h").alias("h"))
    merged = merge_line_rects(lined.drop("y", "h").join(tops, "line"), "line", "x", "y", "w", "h").where((F.col("w") > least) & (F.col("h") > least))
    turned = merged.select(F.col("line.of").alias(key), F.col("line.page").alias("page"), "y", "x", rotated(rect(F.col("x"), F.col("y"), F.col("w"), F.col("h")), F.col("line.rotation")).alias("r"))
    return turned.groupBy(key, "page").agg(F.sort_array(F.collect_list(F.struct("y", "x", "r"))).alias("l")).select(key, "page", F.transform("l", lambda o: o["r"]).alias("rects"))


def column_of(x0: Column, x1: Column, width: float) -> Column:
    """full, left or right: where a block of a page stands."""
    return F.when(x1 - x0 > width * 0.8, "full").when((x0 + x1) / 2 < width / 2, "left").otherwise("right")


def multi_column_pages(blocks: DataFrame, page: str, x0: str, x1: str, width: float) -> DataFrame:
    """Pages with three blocks or more on either side and a gap over a twentieth of the width between their centres."""
    sided = blocks.withColumn("__side", column_of(F.col(x0), F.col(x1), width)).withColumn("__mid", (F.col(x0) + F.col(x1)) / 2)
    left, right = F.when(F.col("__side") == "left", F.col("__mid")), F.when(F.col("__side") == "right", F.col("__mid"))
    pages = sided.groupBy(page).agg(F.count(left).alias("l"), F.count(right).alias("r"), F.max(left).alias("lm"), F.min(right).alias("rm"))
    return pages.select(page, F.coalesce((F.col("l") >= 3) & (F.col("r") >= 3) & (F.col("rm") - F.col("lm") > width * 0.05), F.lit(False)).alias("multi_column"))


def reading_order(blocks: DataFrame, page: str, x0: str, y: str, x1: str, key: str, width: float) -> DataFrame:
    """Blocks numbered as a two-column page is read: full-width blocks fence bands, each read left column first."""
    sided = blocks.withColumn("__side", column_of(F.col(x0), F.col(x1), width))
    fence = (F.col("__side") == "full").cast("int")
    upto = Window.partitionBy(page).orderBy(F.col(y), F.desc(fence), F.col(key)).rowsBetween(Window.unboundedPreceding, 0)
    banded = sided.withColumn("__band", F.sum(fence).over(upto))
    rank = F.when(F.col("__side") == "full", 0).when(F.col("__side") == "left", 1).otherwise(2)
    order = Window.partitionBy(page).orderBy("__band", rank, y, key)
    return banded.withColumn("reading_no", F.row_number().over(order)).drop("__band").withColumnRenamed("__side", "side")
