"""Mixing sources to target weights: Pfair scheduling of source blocks by earliest deadline.

A source's documents, in a fixed shuffled order, are cut into blocks.  With weight w, block j of a source is released at
slot floor(j / w) and due by slot ceil((j + 1) / w); picking the released block with the earliest deadline in every slot
keeps each source within less than one block of its share at all times.  The windows come from the weights as given, by
whole-number arithmetic, so no rounding adds up.  One task works the schedule out, a heap of one entry a source, and writes
it as it goes; every block finds its slot by its number.  A source that runs out takes no more turns, and
the others keep to their windows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, written

_DRAW = 1 << 30


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """The weights as whole numbers in exactly the same proportions."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * scale) for s, w in exact.items()}
    common = math.gcd(*whole.values())
    return {s: w // common for s, w in whole.items()}


def pfair(weights: dict[str, int], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) of every block that a source has, by earliest deadline first.

    A source that has run out takes no more turns; slots in which no block is released yet stay empty.
    """
    total = sum(weights.values())
    waiting = [(0, s, 0) for s in sorted(weights) if blocks[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[s]), s, j, release))
        deadline, s, j, release = heapq.heappop(ready)
        yield s, j, slot, release, deadline
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, ((j + 1) * total // weights[s], s, j + 1))
        slot += 1


def _planned(weights: dict[str, int], blocks: dict[str, int], at_once: int):
    schema = pa.schema([("source", pa.string()), *((c, pa.int64()) for c in ("block", "slot", "release", "deadline"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plan = pfair(weights, blocks) if batch.num_rows else iter(())
            while some := list(islice(plan, at_once)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    return run


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, block: int = 32, slots_at_once: int = 1000, seed: int = 0, rows_per_bucket: int = 5_000) -> DataFrame:
    """Order documents so that each stretch holds the sources by their target weights.

    Returns doc_id, source, block (number within the source), slot, release, deadline and position (order of the mix).
    ``weights`` default to the square root of each source's rows, and sources that it leaves out or gives nothing get the
    smallest weight it has above zero, so every row comes back.  Sources are a catalogue that fits the driver; neither
    their rows nor the schedule go there, and ``slots_at_once`` is the number of its slots written at once.

    A null source is the source ''.  Ranks are counted in buckets of about ``rows_per_bucket`` rows of one source, so a
    source with a third of all rows is spread over many tasks.  Rows that repeat a doc_id are placed one after the
    other, as are those without one.  Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = only(docs, "doc_id", "source").withColumn("source", F.coalesce("source", F.lit("")))
    rows = rows.withColumn("draw", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(_DRAW)))
    held = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}
    schema = "doc_id long, source string, block long, slot long, release long, deadline long, position long"
    if not held:
        return spark.createDataFrame([], schema)
    if weights is None:
        wanted = {s: math.sqrt(n) for s, n in held.items()}
    else:
        given = {s: w for s, w in weights.items() if w > 0}
        wanted = {s: given.get(s, min(given.values(), default=1)) for s in held}
    blocks = {s: -(-n // block) for s, n in held.items()}
    plan = written(spark.range(1, numPartitions=1).mapInArrow(_planned(whole_weights(wanted), blocks, slots_at_once), "source string, block long, slot long, release long, deadline long"), "plan")

    buckets = max(1, -(-max(held.values()) // rows_per_bucket))
    rows = rows.withColumn("bucket", (F.col("draw") * buckets / _DRAW).cast("long"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n")).select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id")
    ranked = rows.withColumn("k", F.row_number().over(inside)).join(offsets, ["source", "bucket"]).withColumn("rank", F.col("offset") + F.col("k") - 1)

    placed = ranked.withColumn("block", F.floor(F.col("rank") / block)).join(plan, ["source", "block"])
    return placed.select("doc_id", "source", "block", "slot", "release", "deadline", (F.col("slot") * block + F.col("rank") % block).alias("position"))
