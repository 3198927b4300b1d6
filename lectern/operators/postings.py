"""Full-text search over stored postings: lexemes with their positions, matched and ranked without reading texts.

A posting is (lexeme, key, positions).  Postings lie in folders by a hash of the lexeme and, inside, in the order of lexemes, so
a question reads the folders of its lexemes and of those only the row groups that hold them.  Documents change by segments:
new postings are appended, and a list of the changed keys says which older ones no longer count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import english

POSTING = "lexeme string, positions array<int>"
# fixed values of the database's rank: the weight of a plain word, the limit of the sum of 1 / n**2, and the terms of the
# weight of a distance between two words
PLAIN_WEIGHT = 0.1
SQUARES = 1.64493406685
FARTHEST, FAR = 100, 1e-30


def near_weights() -> np.ndarray:
    """log(1 - w) for the words of two terms at each distance up to ``FARTHEST``; the last entry is for any beyond."""
    far = np.arange(1, FARTHEST + 1)
    weight = np.append(1 / (1.005 + 0.05 * np.exp(far / 1.5 - 2)), FAR)
    return np.log1p(-PLAIN_WEIGHT * np.sqrt(weight))


def rank_positions(positions: Sequence[np.ndarray]) -> float:
    """The database's rank of one text by the sorted positions of each distinct term that it must have.

    One term: the sum of w / n**2 over its places, by the limit of such sums.  More: one less the product of one less each
    weight of a pair of places of different terms, which falls with their distance.  Only distances up to ``FARTHEST`` are
    looked up one by one, so long texts cost their number of places, not its square.
    """
    if len(positions) == 1:
        return float((PLAIN_WEIGHT / np.arange(1, len(positions[0]) + 1) ** 2).sum() / SQUARES)
    near, total = near_weights(), 0.0
    for i, one in enumerate(positions):
        for other in positions[:i]:
            left = len(one) * len(other)
            few, many = (one, other) if len(one) < len(other) else (other, one)
            low, high = np.searchsorted(many, few - FARTHEST), np.searchsorted(many, few + FARTHEST, side="right")
            count = high - low
            start = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            apart = np.bincount(np.abs(many[start] - np.repeat(few, count)), minlength=FARTHEST + 1)
            total += (apart[1:] * near[:FARTHEST]).sum() + (left - count.sum()) * near[FARTHEST]
    return float(-np.expm1(total))


def _ranks(positions: pd.Series) -> pd.Series:
    return pd.Series([rank_positions([np.asarray(p, dtype=np.int64) for p in of]) for of in positions], dtype="float64")


WORD = re.compile(r"[^\W_]+")  # letters and digits of any script
SLICE_CHARS = 1 << 21


def lexemes(text: str) -> dict[str, list[int]]:
    """Places of each lexeme of a text: words of letters and digits, from 1, stop words counted as places but not kept."""
    _, lexeme, positions = _of_texts(pa.array([0]), [text], None)
    return dict(zip(lexeme.to_pylist(), positions.to_pylist(), strict=True))


def _of_texts(keys: pa.Array, texts: list[str], only: frozenset[str] | None) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Keys, lexemes and places of some texts: each distinct word is stemmed once, the rest is sorting numbers."""
    words: list[str] = []
    counts = []
    for text in texts:
        found = WORD.findall(text.lower())
        words += found
        counts.append(len(found))
    named = pa.array(words, pa.string()).dictionary_encode()
    stems: dict[str, int] = {}
    of_word = np.full(len(named.dictionary), -1, np.int64)
    for i, word in enumerate(named.dictionary.to_pylist()):
        stem = None if word in english.STOP_WORDS else english.stem(word)
        if stem is not None and (only is None or stem in only):
            of_word[i] = stems.setdefault(stem, len(stems))
    counts = np.array(counts, np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
    lexeme = of_word[np.asarray(named.indices)]
    kept = lexeme >= 0
    both = row[kept] * max(1, len(stems)) + lexeme[kept]
    order = np.argsort(both, kind="stable")
    once, first = np.unique(both[order], return_index=True)
    bounds = pa.array(np.append(first, len(order)), pa.int32())
    lists = pa.ListArray.from_arrays(bounds, pa.array(place[kept][order], pa.int32()))
    return keys.take(pa.array(once // max(1, len(stems)))), pa.array(list(stems), pa.string()).take(pa.array(once % max(1, len(stems)))), lists


def _postings(only: frozenset[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            at, held = 0, 0
            for i, text in enumerate(texts):
                held += len(text)
                if held > SLICE_CHARS or i == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays(list(_of_texts(keys[at : i + 1], texts[at : i + 1], only)), names=["key", "lexeme", "positions"])
                    at, held = i + 1, 0

    return run


def postings(chunks: DataFrame, *, key: str = "id", content: str = "content", only: Sequence[str] | None = None) -> DataFrame:
    """(key, lexeme, positions) of every text, or of the named lexemes alone.  Keys are whole numbers."""
    return chunks.select(F.col(key).cast("long").alias("key"), F.col(content).alias("content")).mapInArrow(_postings(None if only is None else frozenset(only)), f"key long, {POSTING}")


def matches(found: DataFrame, terms: Sequence[str], *, key: str = "id", score: str = "keyword_score") -> DataFrame:
    """(key, score) of the keys that hold every term, ranked by the places of the terms; without terms none."""
    wanted = found.where(F.col("lexeme").isin(*terms)) if terms else found.where(F.lit(False))
    held = wanted.groupBy("key").agg(F.collect_list("positions").alias("places")).where(F.size("places") == len(terms))
    return held.select(F.col("key").alias(key), F.round(F.pandas_udf(_ranks, "double")("places"), 6).alias(score))


def bucket_of(lexeme: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(buckets)).cast("int")


class PostingsIndex:
    """A stored index in ``folder``; ``buckets`` is fixed when it is made and each is read by the questions that need it."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, spread: int = 1):
        self.spark, self.folder, self.buckets, self.spread = spark, folder, buckets, spread

    def write(self, chunks: DataFrame, segment: int, *, key: str = "id", content: str = "content") -> PostingsIndex:
        """Append the postings of some chunks; from ``segment`` on they take the place of older ones of the same keys.

        Keys without a text are forgotten.  A segment that is written again, as after a failure, replaces itself.
        ``spread`` is the number of tasks that share a bucket, for lexemes that very many texts have.
        """
        rows = postings(chunks, key=key, content=content).withColumn("bucket", bucket_of(F.col("lexeme"), self.buckets))
        dealt = rows.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(self.spread))).sortWithinPartitions("bucket", "lexeme", "key")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings/segment={segment}")
        # nothing is older than segment 0
        changed = chunks.select(F.col(key).cast("long").alias("key")).distinct() if segment else self.spark.createDataFrame([], "key long")
        changed.write.mode("overwrite").parquet(f"{self.folder}/changed/segment={segment}")
        return self

    def postings_of(self, terms: Sequence[str]) -> DataFrame:
        """Postings of the terms that still count."""
        stored = self.spark.read.schema(f"key long, {POSTING}, segment int, bucket int").option("basePath", f"{self.folder}/postings").parquet(f"{self.folder}/postings")
        asked = self.spark.range(1).select(*(bucket_of(F.lit(t), self.buckets).alias(str(i)) for i, t in enumerate(terms))).first() if terms else []
        some = stored.where(F.col("bucket").isin(*set(asked)) & F.col("lexeme").isin(*terms)) if terms else stored.where(F.lit(False))
        changed = self.spark.read.schema("key long, segment int").option("basePath", f"{self.folder}/changed").parquet(f"{self.folder}/changed").where("segment > 0")
        newest = changed.groupBy("key").agg(F.max("segment").alias("newest"))
        return some.join(newest, "key", "left").where(F.col("newest").isNull() | (F.col("segment") >= F.col("newest"))).select("key", "lexeme", "positions")

    def matches(self, terms: Sequence[str], *, key: str = "id", score: str = "keyword_score") -> DataFrame:
        return matches(self.postings_of(terms), terms, key=key, score=score)
