"""Hard-negative mining over rotated one-bit codes.

Every vector is turned by one random rotation and coded by the signs of its components; stored beside the code is its
alignment with the vector (how far to go along the code).  What is left over is coded in the same way, level by level, so a
vector is a sum of aligned sign codes and a residual of known length.  An anchor's components are rounded to 8 bits and
kept as bit planes, so its product with a code is a few popcounts.  The residual's share of a product is bounded by the
Cauchy-Schwarz inequality, which gives every product a certain interval: a row is dropped only if its whole interval
lies outside what the anchor still looks for.  Rows whose intervals survive all levels are scored by whole numbers.

Anchors come in blocks of bounded bytes; a block meets all rows in one pass, in which each task keeps the best few rows of
every anchor, so tasks send a few rows an anchor and no row is moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, arrow_batch, column, new_folder, shown_id

BITS = 8
LARGEST = 1 << 52  # a product's bound: doubles hold it exactly, and a hundred times it fits a long
SLACK = 1e-9  # of the product of two lengths, for the rounding of doubles
PAIRS = 1 << 17  # compared at once
EXACT = 1 << 15  # scored at once


def rotation(size: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def signs_packed(x: np.ndarray) -> np.ndarray:
    """One bit a component (set where it is at least 0), in words of 64."""
    return np.packbits(x >= 0, axis=1, bitorder="little").view(np.uint64)


def coded(x: np.ndarray, turn: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (n, levels, words), alignments, lengths of the coded part and of the residual (n, levels) of whole vectors."""
    size = len(turn)
    left = np.zeros((len(x), size))
    left[:, : x.shape[1]] = x
    left = left @ turn.T
    whole, known = left.copy(), np.zeros_like(left)
    codes = np.zeros((len(x), levels, size // 64), np.uint64)
    align, held, rest = (np.zeros((len(x), levels)) for _ in range(3))
    for k in range(levels):
        codes[:, k] = signs_packed(left)
        align[:, k] = np.abs(left).mean(axis=1)
        known += align[:, k, None] * np.where(left >= 0, 1.0, -1.0)
        left = whole - known
        held[:, k], rest[:, k] = np.linalg.norm(known, axis=1), np.linalg.norm(left, axis=1)
    return codes, align, held, rest


def _matrix(lists: pa.Array, kind: type, *shape: int) -> np.ndarray:
    return np.asarray(lists.flatten()).astype(kind, copy=False).reshape(len(lists), *shape)


class Rows:
    """Some rows of the coded table as arrays."""

    def __init__(self, batch: pa.RecordBatch, levels: int):
        self.row, self.key, self.label = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("row", "key", "label"))
        self.whole = _matrix(column(batch, "whole"), np.int64, -1) if batch.num_rows else np.zeros((0, 0), np.int64)
        self.codes = _matrix(column(batch, "codes"), np.int64, levels, -1).view(np.uint64) if batch.num_rows else np.zeros((0, levels, 1), np.uint64)
        self.align, self.held, self.rest = (_matrix(column(batch, c), np.float64, levels) if batch.num_rows else np.zeros((0, levels)) for c in ("align", "held", "rest"))


class Anchors:
    """A block of anchors: their whole vectors, and bit planes of their turned and rounded components."""

    def __init__(self, rows: Rows, turn: np.ndarray):
        self.row, self.key, self.label, self.whole = rows.row, rows.key, rows.label, rows.whole
        turned = np.zeros((len(rows.row), len(turn)))
        turned[:, : rows.whole.shape[1]] = rows.whole
        turned = turned @ turn.T
        self.step = np.maximum(np.abs(turned).max(axis=1, initial=0), 1e-300) / (2 ** (BITS - 1) - 1)
        rounded = np.rint(turned / self.step[:, None])
        self.off = np.linalg.norm(turned - rounded * self.step[:, None], axis=1)
        self.length = np.linalg.norm(turned, axis=1)
        shifted = (rounded + 2 ** (BITS - 1)).astype(np.int64)
        bits = (shifted[:, None, :] >> np.arange(BITS)[None, :, None]) & 1
        self.planes = np.stack([signs_packed(bits[:, b] - 0.5) for b in range(BITS)], axis=1)
        self.base = shifted.sum(axis=1)
        self.size = len(turn)

    def along(self, codes: np.ndarray, a) -> np.ndarray:
        """Products of sign codes (…, words) with the rounded components of anchors ``a``, by popcounts."""
        planes = self.planes[a]
        total = np.zeros(np.broadcast_shapes(codes.shape[:-1], planes.shape[:-2]), np.int64)
        for b in range(BITS):
            for w in range(codes.shape[-1]):
                total += np.bitwise_count(codes[..., w] & planes[..., b, w]).astype(np.int64) << (b + 1)
        ones = np.bitwise_count(codes).sum(axis=-1, dtype=np.int64)
        return (total - self.base[a] - 2 ** (BITS - 1) * (2 * ones - self.size)) * self.step[a]

    def surviving(self, rows: Rows, r: np.ndarray, a: np.ndarray, low: np.ndarray, high: np.ndarray, apart: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows ``r`` and anchors ``a`` whose product may lie between the anchor's ``low`` and ``high``.

        The pairs are all of them at the first level, those with another label only if ``apart``.
        """
        ri, ai = np.repeat(r, len(a)), np.tile(a, len(r))
        if apart:
            other = rows.label[ri] != self.label[ai]
            ri, ai = ri[other], ai[other]
        seen = np.zeros(len(ri))
        for k in range(rows.align.shape[1]):
            if k == 0 and not apart:
                along = self.along(rows.codes[r, 0][:, None, :], a[None, :]).ravel()
            else:
                along = self.along(rows.codes[ri, k], ai)
            seen += rows.align[ri, k] * along
            # the residual stands upright on its level's code, so only what the anchor has beside that code counts
            beside = np.maximum(np.abs(along) / np.sqrt(self.size) - self.off[ai], 0)
            length = self.length[ai]
            wide = rows.held[ri, k] * self.off[ai] + rows.rest[ri, k] * np.sqrt(np.maximum(length**2 - beside**2, 0))
            wide += SLACK * (rows.held[ri, k] + rows.rest[ri, k]) * length
            keep = (seen + wide >= low[ai]) & (seen - wide <= high[ai])
            ri, ai, seen = ri[keep], ai[keep], seen[keep]
        return ri, ai

    def scores(self, rows: Rows, ri: np.ndarray, ai: np.ndarray) -> np.ndarray:
        out = np.empty(len(ri), np.int64)
        for at in range(0, len(ri), EXACT):
            part = slice(at, at + EXACT)
            out[part] = np.einsum("ij,ij->i", rows.whole[ri[part]], self.whole[ai[part]])
        return out


class Best:
    """The first few entries of each slot by score, then key; their scores bound what may still enter."""

    def __init__(self, slots: int, most: int):
        self.slots, self.most = slots, most
        self.slot, self.score, self.key = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(slots, -np.inf)

    def add(self, slot: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        slot, score, key = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.key, key)))
        order = np.lexsort((key, -score, slot))
        slot = slot[order]
        first = np.searchsorted(slot, slot)
        place = np.arange(len(slot)) - first
        order, slot, place = order[place < self.most], slot[place < self.most], place[place < self.most]
        self.slot, self.score, self.key = slot, score[order], key[order]
        last = place == self.most - 1
        self.least[slot[last]] = self.score[last]


def _positives(anchors: Anchors, most: int, levels: int):
    """Tasks' best rows of the anchors' own labels: (anchor, score, key)."""
    schema = pa.schema([("anchor", pa.int64()), ("score", pa.int64()), ("key", pa.int64())])
    of_label = {v: np.flatnonzero(anchors.label == v) for v in np.unique(anchors.label)}
    no_limit = np.full(len(anchors.row), np.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(anchors.row), most)
        for rows in (Rows(batch, levels) for batch in batches if batch.num_rows):
            for v in np.unique(rows.label):
                if v not in of_label:
                    continue
                members, mine = np.flatnonzero(rows.label == v), of_label[v]
                per = max(1, PAIRS // len(mine))
                for at in range(0, len(members), per):
                    ri, ai = anchors.surviving(rows, members[at : at + per], mine, best.least, no_limit)
                    other = rows.row[ri] != anchors.row[ai]
                    ri, ai = ri[other], ai[other]
                    if len(ri):
                        best.add(ai, anchors.scores(rows, ri, ai), rows.key[ri])
        if len(best.slot):
            yield arrow_batch(schema, (best.slot, best.score, best.key))

    return run


def _negatives(anchors: Anchors, score: np.ndarray, key: np.ndarray, most: int, low: int, levels: int):
    """Tasks' best rows of other labels below each positive: ``score`` and ``key`` (anchors, positives), score -1 where there is none."""
    schema = pa.schema([(c, pa.int64()) for c in ("anchor_row", "slot", "anchor_key", "positive_key", "negative_key", "positive_score", "negative_score")])
    per_anchor = score.shape[1]
    least = np.where(score >= 0, -((-low * score) // 100), 0).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(score.size, most)
        asked = np.flatnonzero((score >= 0).any(axis=1))
        high = score.max(axis=1, initial=-1).astype(np.float64)
        per = max(1, PAIRS // max(1, len(asked)))
        for rows in (Rows(batch, levels) for batch in batches if batch.num_rows):
            for at in range(0, len(rows.row), per):
                bar = np.where(score >= 0, np.maximum(least, best.least.reshape(score.shape)), np.inf).min(axis=1, initial=np.inf)
                ri, ai = anchors.surviving(rows, np.arange(at, min(at + per, len(rows.row))), asked, bar, high, apart=True)
                if not len(ri):
                    continue
                got = anchors.scores(rows, ri, ai)
                for p in range(per_anchor):
                    at_p = score[ai, p]
                    fits = (at_p >= 0) & (low * at_p <= 100 * got) & (got <= at_p)
                    if fits.any():
                        best.add(ai[fits] * per_anchor + p, got[fits], rows.key[ri[fits]])
        if len(best.slot):
            a, p = best.slot // per_anchor, best.slot % per_anchor
            yield arrow_batch(schema, (anchors.row[a], best.slot, anchors.key[a], key[a, p], best.key, score[a, p], best.score))

    return run


def _encoder(size: int, levels: int, scale: float, seed: int):
    schema = pa.schema([("whole", pa.list_(pa.int64())), ("codes", pa.list_(pa.int64())), *((c, pa.list_(pa.float64())) for c in ("align", "held", "rest"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(max(64, -(-size // 64) * 64), seed)
        for batch in batches:
            vectors = column(batch, "vector")
            n = np.asarray(pc.list_value_length(vectors))
            x = np.zeros((len(n), size))
            x[np.arange(size)[None, :] < n[:, None]] = np.asarray(vectors.flatten())
            x = np.floor(scale * x)
            if size * float(np.abs(x).max(initial=0)) ** 2 >= LARGEST:
                raise ValueError("components are too large for whole products of 64 bits")
            codes, align, held, rest = coded(x, turn, levels)
            lists = [x.astype(np.int64), codes.view(np.int64).reshape(len(x), -1), align, held, rest]
            listed = [pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel())) for v in lists]
            plain = [column(batch, c) for c in ("row", "key", "label")]
            yield pa.RecordBatch.from_arrays([*plain, *(v.cast(f.type) for v, f in zip(listed, schema, strict=True))], names=["row", "key", "label", *schema.names])

    return run


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
CODED = "row long, key long, label long, whole array<long>, codes array<long>, align array<double>, held array<double>, rest array<double>"


def mine_hard_negatives(
    vectors: DataFrame, anchor: Column, label: Column, positives: int = 5, negatives: int = 5, low: int = 80, scale: float = 256.0, levels: int = 4, block_bytes: int = 16 << 20, seed: int = 11
) -> DataFrame:
    """Rows of other labels that score just below an anchor's best rows of its own label.

    ``vectors`` has vec_id and embedding; ``anchor`` says which rows ask and ``label`` gives their class (whole numbers).
    Components are taken as floor(scale * x) and a score is the whole inner product.  For each anchor and each of its first
    ``positives`` other rows of its label, the first ``negatives`` rows of other labels whose score is at most the
    positive's and at least ``low`` hundredths of it (none if it is under 0), in the order of score, then vec_id.

    Rows with a null label, a null vector or a component that is null or not finite take no part.  Shorter vectors count
    as filled up with 0.  Rows without a vec_id stand before all others among ties and are never dropped for it; a null
    ``anchor`` is none.  Rows that repeat a vec_id are rows of their own: each can ask, and each counts.  Other columns are
    ignored, an empty table gives an empty result, and components so large that a product may pass 2**52 raise an error.

    Anchors are held in blocks of ``block_bytes``; every block is one pass over the coded rows.
    """
    spark = vectors.sparkSession
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(sound).select(F.coalesce("vec_id", F.lit(NO_ID)).alias("key"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("asks"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where("label IS NOT NULL")
    size = rows.agg(F.max(F.size("vector"))).first()[0]
    if size is None:
        return spark.createDataFrame([], OUT)
    folder = new_folder(spark, "negatives")
    asking, idle = (1 << 62), 0  # the row number's second-highest bit says whether a row asks
    numbered = rows.select((F.monotonically_increasing_id() + F.when(F.col("asks"), asking).otherwise(idle)).alias("row"), "key", "label", "vector")
    numbered.mapInArrow(_encoder(size, levels, scale, seed), CODED).write.parquet(f"{folder}/codes")
    codes = spark.read.schema(CODED).parquet(f"{folder}/codes")

    asks = codes.where(F.col("row") >= asking)
    blocks = max(1, -(-asks.count() * (size * 24 + 256) // block_bytes))
    turn = rotation(max(64, -(-size // 64) * 64), seed)
    spark.createDataFrame([], OUT).write.parquet(f"{folder}/found")
    for b in range(blocks):
        held = asks.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if not held.num_rows:
            continue
        anchors = Anchors(Rows(held.to_batches()[0], levels), turn)
        first = Window.partitionBy("anchor").orderBy(F.desc("score"), "key")
        best = codes.mapInArrow(_positives(anchors, positives, levels), "anchor long, score long, key long").withColumn("k", F.row_number().over(first)).where(F.col("k") <= positives)
        of = best.toArrow()
        score, key = np.full((len(anchors.row), positives), -1, np.int64), np.zeros((len(anchors.row), positives), np.int64)
        at = of["anchor"].to_numpy(), of["k"].to_numpy() - 1
        score[at], key[at] = of["score"].to_numpy(), of["key"].to_numpy()
        nearest = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("negative_score"), "negative_key")
        found = codes.mapInArrow(
            _negatives(anchors, score, key, negatives, low, levels),
            "anchor_row long, slot long, anchor_key long, positive_key long, negative_key long, positive_score long, negative_score long",
        )
        found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= negatives).select(
            shown_id(F.col("anchor_key")).alias("anchor_id"), shown_id(F.col("positive_key")).alias("positive_id"), F.col("rank").cast("int").alias("rank"),
            shown_id(F.col("negative_key")).alias("negative_id"), "positive_score", "negative_score",
        ).write.mode("append").parquet(f"{folder}/found")
    return spark.read.schema(OUT).parquet(f"{folder}/found")
