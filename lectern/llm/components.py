"""Connected components by contraction, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of an edge (src, dst); the component is its smallest node.

    In each round every node takes the name of the first among itself and its neighbours, in an order that a hash draws anew
    for the round, and nodes of one name become one.  Whatever the shape of the graph and the order of its ids, a fixed
    share of the nodes goes each time, so the rounds follow the logarithm of the nodes, on chains too, and the tables
    shrink.  Then the names are followed back from the last round to the first.  A hub costs one partial row a task where
    names are taken; every round's tables are written to the shared folder, and go when they are used up.
    """
    pairs = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    pairs = written(pairs.where("src <> dst").distinct(), "pairs")
    least = pairs.select(F.col("src").alias("node"), F.col("src").alias("least")).distinct()
    rounds: list[DataFrame] = []
    while not pairs.isEmpty():
        draw = lambda c: F.xxhash64(F.lit(len(rounds)), c)  # noqa: B023, E731
        near = pairs.groupBy("src").agg(F.min(draw("dst")).alias("least_draw"), F.min_by("dst", draw("dst")).alias("near"))
        first = near.select(F.col("src").alias("node"), F.when(draw("src") <= F.col("least_draw"), F.col("src")).otherwise(F.col("near")).alias("name"))
        named = written(first.join(least, "node"), "named")
        rounds.append(named)
        src, dst = named.select(F.col("node").alias("src"), F.col("name").alias("a")), named.select(F.col("node").alias("dst"), F.col("name").alias("b"))
        joined = pairs.join(src, "src").join(dst, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
        fewer = written(joined, "pairs")
        discard(pairs)
        pairs = fewer
        least = named.groupBy("name").agg(F.min("least").alias("least")).withColumnRenamed("name", "node")
    if not rounds:
        return least.select("node", F.col("least").alias("component"))
    known = None
    for named in reversed(rounds):
        ends = named.groupBy("name").agg(F.min("least").alias("component"))
        if known is not None:
            later = known.select(F.col("node").alias("name"), F.col("component").alias("later"))
            ends = ends.join(later, "name", "left").select("name", F.coalesce("later", "component").alias("component"))
        before, known = known, written(named.select("node", "name").join(ends, "name").select("node", "component"), "components")
        if before is not None:
            discard(before)
    discard(*rounds)
    return known
