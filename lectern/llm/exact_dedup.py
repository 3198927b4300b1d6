"""Exact dedup: static binary-fuse filters of an immutable snapshot screen the digests of a new batch.

A snapshot is a table of distinct digests, dealt into buckets by digest, each with one row per digest (best row, row
count) and, per bucket, a 3-wise binary-fuse filter with 16-bit prints.  New rows are digested and grouped among
themselves first (partial aggregation, so a digest that a third of the rows share costs one partial row a task).  Their
distinct digests meet the filters bucket by bucket; a negative is proven new, a positive joins the exact bucket and is
settled by comparing the normalised bytes of one text from each side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, column, doc_key, only, shown_id, written
from .words import BLANK, mix, text_bytes, text_slices

#: Pairs of equal digests that are sent to every task for the byte check.
MOST_SENT = 100_000

_DIGESTS = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("points", pa.int64()), ("size", pa.int64())])
_DIGESTS_DDL = "doc_id long, digest string, points long, size long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            data, offsets = text_bytes(column(part, "text"))
            solid = ~BLANK[data]
            heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            left = np.concatenate([[0], np.cumsum(solid)])[offsets]
            packed = memoryview(data[solid])
            hexes = [hashlib.sha256(packed[left[i] : left[i + 1]]).hexdigest() for i in range(part.num_rows)]
            points = heads[offsets[1:]] - heads[offsets[:-1]]
            yield arrow_batch(_DIGESTS, [column(part, "doc_id"), hexes, points, np.diff(left)])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, SHA-256 of the text without ASCII blanks, code points of the original, bytes of the normalised text."""
    return only(docs, "doc_id", "text").mapInArrow(_digests, _DIGESTS_DDL)


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]", "")


# -- binary-fuse filter -------------------------------------------------------------------------------------------


def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots in neighbouring segments, and a 16-bit print, for each key."""
    h = mix(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
    first = (h >> np.uint64(33)) % np.uint64(segments)
    mask = np.uint64(segment - 1)
    slots = np.stack([first * np.uint64(segment) + (h & mask)] + [(first + np.uint64(j)) * np.uint64(segment) + (mix(h + np.uint64(j)) & mask) for j in (1, 2)])
    return slots.astype(np.int64), (mix(h ^ np.uint64(0x5555)) >> np.uint64(48)).astype(np.uint16)


def build_fuse_filter(keys: np.ndarray) -> bytes:
    """A static filter over distinct uint64 keys: no false negatives, 2**-16 false positives.

    Keys are peeled in rounds: all slots that hold one key only are taken at once (each round is one pass of array
    operations), and assigned in reverse.  An unlucky seed leaves a core that does not peel; the next seed is tried.
    """
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    segment = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
    segments = max(1, int(np.ceil(max(n, 1) * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 4))) / segment)))
    size = (segments + 2) * segment
    for seed in range(1, 200):
        slots, prints = _places(keys, seed, segment, segments)
        count = np.bincount(slots.ravel(), minlength=size)
        acc = np.zeros(size, dtype=np.int64)
        for j in range(3):
            np.bitwise_xor.at(acc, slots[j], np.arange(n))
        alive, order = np.ones(n, dtype=bool), []
        while alive.any():
            single = np.flatnonzero(count == 1)
            picked, where = np.unique(acc[single], return_index=True)
            if not len(picked):
                break
            order.append((picked, single[where]))
            alive[picked] = False
            for j in range(3):
                np.subtract.at(count, slots[j][picked], 1)
                np.bitwise_xor.at(acc, slots[j][picked], picked)
        if alive.any():
            continue
        table = np.zeros(size, dtype=np.uint16)
        for picked, own in reversed(order):
            # each picked key owns a slot that no key picked in the same or a later round reads
            others = prints[picked].copy()
            for j in range(3):
                others ^= np.where(slots[j][picked] == own, 0, table[slots[j][picked]]).astype(np.uint16)
            table[own] = others
        return np.array([seed, segment, segments], dtype="<i8").tobytes() + table.astype("<u2").tobytes()
    raise ValueError("no seed peels these keys")


def probe_fuse_filter(data: bytes, keys: np.ndarray) -> np.ndarray:
    seed, segment, segments = (int(x) for x in np.frombuffer(data, "<i8", 3))
    table = np.frombuffer(data, "<u2", offset=24)
    slots, prints = _places(keys.astype(np.uint64), seed, segment, segments)
    return (table[slots[0]] ^ table[slots[1]] ^ table[slots[2]]) == prints


def _key(digest: str = "digest") -> Column:
    """The digest's first 63 bits as a whole number; the filter's key."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _bucket(buckets: int, digest: str = "digest") -> Column:
    return F.pmod(F.conv(F.substring(digest, 17, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def _best() -> Column:
    """The row that stays: most code points, then smallest doc_id."""
    return F.min(F.struct((-F.col("points")).alias("points"), "doc_id")).alias("best")


def group_digests(rows: DataFrame) -> DataFrame:
    """One row per digest: its best row and its row count."""
    return rows.groupBy("digest").agg(_best(), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))


def snapshot(rows: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """The exact buckets of a snapshot's digests and one filter per bucket, both written and never changed."""
    exact = written(group_digests(rows).withColumn("bucket", _bucket(buckets)), "snapshot_digests")

    def build(key, pdf):
        import pandas as pd

        return pd.DataFrame({"bucket": [key[0]], "fuse": [build_fuse_filter(pdf["key"].to_numpy(np.int64).view(np.uint64))]})

    keyed = exact.select("bucket", _key().alias("key"))
    return exact, written(keyed.groupBy("bucket").applyInPandas(build, "bucket int, fuse binary"), "snapshot_filters")


def _screen(keyed: DataFrame, filters: DataFrame) -> DataFrame:
    """Digests that their bucket's filter does not rule out."""

    def probe(keys, fuses):
        if len(keys) == 0 or len(fuses) == 0:
            return keys.iloc[:0][["digest"]]
        return keys.loc[probe_fuse_filter(fuses["fuse"].iloc[0], keys["key"].to_numpy(np.int64).view(np.uint64)), ["digest"]]

    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(probe, "digest string")


def exact_dedup(docs: DataFrame, incoming: Column, rows_per_bucket: int = 200_000, keyed: bool = False) -> DataFrame:
    """Group rows whose texts are equal without ASCII blanks; ``incoming`` tells the new batch from the snapshot.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256.  Of equal texts the row with the most
    code points in the original stays, then the smallest doc_id.

    Null texts count as empty, and empty texts are equal.  Rows that repeat a doc_id count each in group_size and are all
    marked kept when their id is the one that stays.  Rows with a null doc_id stand before all others, those of one text as
    repeats of one id, and come back with null (``keyed``: with the key that stands for it).  Extra columns are ignored; an empty table gives an empty result.
    """
    base = only(docs.withColumn("__new", F.coalesce(incoming, F.lit(False))), "doc_id", "text", "__new").withColumn("doc_id", doc_key())
    old, new = base.where(~F.col("__new")), base.where("__new")
    old_rows, new_rows = digests(old), digests(new)

    # both the keys of a filter and the batch's keys that meet it number about rows_per_bucket
    larger = base.groupBy("__new").count().agg(F.max("count")).first()[0] or 0
    exact, filters = snapshot(old_rows, buckets := max(1, -(-larger // rows_per_bucket)))

    batch = written(group_digests(new_rows), "batch_digests")
    positives = _screen(batch.select("digest", _bucket(buckets).alias("bucket"), _key().alias("key")), filters)

    met = positives.join(batch.select("digest", F.col("best.doc_id").alias("new_id")), "digest")
    pairs = written(met.join(exact.select("digest", F.col("best.doc_id").alias("old_id")), "digest"), "digest_pairs")
    # a pair of one digest and other bytes would stay two groups
    apart = pairs.select("digest").join(_same_bytes(base, pairs), "digest", "left_anti").select("digest", F.lit(True).alias("apart"))

    def sided(rows: DataFrame, is_new: bool) -> DataFrame:
        if not is_new:
            return rows.withColumn("apart", F.lit(False))
        return rows.join(apart, "digest", "left").withColumn("apart", F.coalesce("apart", F.lit(False)))

    groups = (
        sided(exact.select("digest", "best", "n"), False).unionByName(sided(batch.select("digest", "best", "n"), True))
        .groupBy("digest", "apart").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
    )
    # a further key, so that both sides are exchanged for this join alone and Spark can split a digest's many rows
    key = F.xxhash64("digest", "apart")
    rows = sided(old_rows, False).unionByName(sided(new_rows, True)).withColumn("key", key)
    return rows.join(groups.withColumn("key", key), ["key", "digest", "apart"]).select(
        (F.col("doc_id") if keyed else shown_id(F.col("doc_id"))).alias("doc_id"),
        (F.col("best.doc_id") if keyed else shown_id(F.col("best.doc_id"))).alias("keep_id"),
        "group_size",
        (F.col("doc_id") == F.col("best.doc_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def _same_bytes(base: DataFrame, pairs: DataFrame) -> DataFrame:
    """Digests whose two texts, one of each side, hold the same normalised bytes."""
    wanted = pairs.select("digest", F.explode(F.array("new_id", "old_id")).alias("doc_id"))
    if pairs.count() <= MOST_SENT:
        wanted = F.broadcast(wanted)  # some 200 bytes a pair; beyond the bound the texts are dealt by doc_id instead
    bodies = base.select("doc_id", "text").join(wanted, "doc_id").select("digest", normalised("text").alias("body"))
    bodies = bodies.where(F.sha2("body", 256) == F.col("digest"))  # rows that repeat a doc_id may hold other texts
    return bodies.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high")).where("low = high").select("digest")
