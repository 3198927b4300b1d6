"""Substring dedup by seed and extend: documents meet at winnowed anchors, matches grow over equal words, long repeats go.

1. Exact copies (equal word sequences, by SHA-256) are folded first: all but the smallest doc_id are repeats from end to
   end and need no search.
2. Winnowing picks, in every window of ``window`` words, the smallest hash of the ``seed``-word grams inside it.  Equal
   windows pick the same gram at the same offset, so documents that share a window meet at that anchor.  Anchors are
   counted with map-side combine; those seen once are dropped and the others go back to their documents.
3. An anchor is extended both ways over all windows that chose it: its stretch, of ``window`` words up to
   2 * ``window`` - ``seed``.  Stretches meet by their words themselves, and all but the first of equal ones repeat it from
   end to end.  The first ones are compared by their windows, under two independent 64-bit prints of the words, and a
   window that is not the first of its kind repeats an earlier one.
4. Repeated windows of neighbouring anchors that overlap join up into maximal repeats, all of ``window`` words or more, and
   their words are removed.

No step gathers the places of one anchor, stretch or window: a passage that a third of all documents share costs one
partial row a task, and what goes back to the documents are the places of first ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, column, doc_key, only
from .words import Words, text_slices

_PRINTS = pa.schema([("doc_id", pa.int64()), ("shown", pa.int64()), ("n_words", pa.int64()), ("digest", pa.binary())])
_ANCHORS = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32())])
_STRETCHES = pa.schema([("doc_id", pa.int64()), ("at", pa.int32()), ("words", pa.string())])
_REPEATS = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64())]))
_KEPT = pa.schema([("shown", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("repeats", _REPEATS)])
_REPEATS_DDL = "array<struct<start:long,n_words:long>>"
_DDL = {
    "prints": "doc_id long, shown long, n_words long, digest binary",
    "anchors": "anchor long, doc_id long, at int",
    "stretches": "doc_id long, at int, words string",
    "kept": f"shown long, n_words long, n_removed long, kept_text string, repeats {_REPEATS_DDL}",
}


def _pieces(words: Words, row: int) -> list[bytes]:
    return words.data[words.offsets[row] : words.offsets[row + 1]].tobytes().split()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words of each text and the digest of its word sequence."""
    for batch in batches:
        for part in text_slices(batch):
            words = Words(column(part, "text"), hashed=False)
            digests = [hashlib.sha256(b" ".join(_pieces(words, i))).digest() for i in range(part.num_rows)]
            yield arrow_batch(_PRINTS, [column(part, "doc_id"), column(part, "shown"), words.counts, pa.array(digests, pa.binary())])


def _owners(words: Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows of a slice, the anchor position each chose, and all seed hashes."""
    whole = words.whole(window)
    grams = words.grams(seed)
    if not whole.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    width = window - seed + 1
    choice = np.lib.stride_tricks.sliding_window_view(grams[: len(whole) + width - 1], width).argmin(axis=1)
    starts = np.flatnonzero(whole)
    return starts, starts + choice[starts], grams


def _anchors(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                words = Words(column(part, "text"))
                _, owner, grams = _owners(words, window, seed)
                owner = np.unique(owner)
                ids = np.asarray(column(part, "doc_id"))
                row = words.row[owner] if len(owner) else owner
                yield arrow_batch(_ANCHORS, [grams[owner], ids[row], (owner - words.row_from[row]).astype(np.int32)])

    return run


def _marks(words: Words, lists: pa.Array) -> np.ndarray:
    """For each word whether it stands at a place of its row's list; null lists are empty."""
    row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64))
    at = np.asarray(lists.flatten(), dtype=np.int64)
    inside = at < words.counts[row]
    out = np.zeros(len(words.starts), dtype=bool)
    out[words.row_from[row[inside]] + at[inside]] = True
    return out


def _at_places(words: Words, places: pa.Array, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that chose an anchor which repeats, and for each the first start of its stretch."""
    starts, owner, _ = _owners(words, window, seed)
    chosen = _marks(words, places)[owner] if len(owner) else np.zeros(0, dtype=bool)
    starts, owner = starts[chosen], owner[chosen]
    if not len(starts):
        return starts, starts
    first = np.r_[True, owner[1:] != owner[:-1]]
    return starts, starts[np.flatnonzero(first)[np.cumsum(first) - 1]]


def _stretches(window: int, seed: int):
    """The words of each anchor's stretch, and where they start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                words = Words(column(part, "text"))
                starts, stretch = _at_places(words, column(part, "places"), window, seed)
                low, count = np.unique(stretch, return_counts=True)
                high = low + count + window - 2
                texts = [b" ".join(words.data[a:b].tobytes().split()) for a, b in zip(words.starts[low].tolist(), words.ends[high].tolist(), strict=True)]
                ids = np.asarray(column(part, "doc_id"))
                row = words.row[low] if len(low) else low
                yield arrow_batch(_STRETCHES, [ids[row], (low - words.row_from[row]).astype(np.int32), pa.array(texts, pa.binary())])

    return run


def maximal_repeats(starts: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of the runs of words that windows at these sorted starts, with these rows, cover."""
    if not len(starts):
        return starts, starts
    fresh = np.r_[True, (starts[1:] > starts[:-1] + window) | (row[1:] != row[:-1])]
    first = np.flatnonzero(fresh)
    last = np.r_[first[1:], len(starts)] - 1
    return starts[first], starts[last] + window - starts[first]


def _strip(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                words = Words(column(part, "text"))
                starts, stretch = _at_places(words, column(part, "places"), window, seed)
                first_stretch, first_window = _marks(words, column(part, "leaders")), _marks(words, column(part, "firsts"))
                repeated = starts[~(first_stretch[stretch] & first_window[starts])]
                low, n = maximal_repeats(repeated, words.row[repeated] if len(repeated) else repeated, window)
                row = words.row[low] if len(low) else low
                depth = np.zeros(len(words.starts) + 1, dtype=np.int32)
                np.add.at(depth, low, 1)
                np.add.at(depth, low + n, -1)
                gone = np.cumsum(depth[:-1]) > 0
                totals = np.concatenate([[0], np.cumsum(gone)])
                removed = totals[words.row_from[1:]] - totals[words.row_from[:-1]]
                texts = []
                for i in range(part.num_rows):
                    pieces = _pieces(words, i)
                    if removed[i]:
                        keep = ~gone[words.row_from[i] : words.row_from[i + 1]]
                        pieces = [pieces[j] for j in np.flatnonzero(keep)]
                    texts.append(b" ".join(pieces))
                found = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (low - words.row_from[row], n)], fields=list(_REPEATS.value_type))
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield arrow_batch(_KEPT, [column(part, "shown"), words.counts, removed, pa.array(texts, pa.binary()), pa.ListArray.from_arrays(pa.array(bounds), found)])

    return run


def _listed(firsts: DataFrame, name: str) -> DataFrame:
    return firsts.select("first.doc_id", "first.at").groupBy("doc_id").agg(F.collect_list("at").alias(name))


AFTER_ALL = 1 << 62  # keys from here on stand after every doc_id
MOST_SENT = 100_000  # ids that are sent to every task; more are dealt out, with the same result


def _one_text_each(docs: DataFrame) -> DataFrame:
    """(doc_id, shown, text): doc_id is the key that one text alone has, shown the id that the row came with.

    Of the different texts under one id, the first by a hash keeps the id as its key; the others get keys after all ids.
    """
    keyed = only(docs, "doc_id", "text").select(doc_key().alias("doc_id"), F.col("doc_id").alias("shown"), "text")
    several = keyed.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("first"), F.max(F.xxhash64("text")).alias("last")).where("first <> last").select("doc_id", "first")
    n = several.count()
    if not n:
        return keyed
    met = keyed.join(F.broadcast(several) if n <= MOST_SENT else several, "doc_id", "left")
    moved = F.lit(AFTER_ALL) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62))
    return met.select(F.when(F.xxhash64("text") != F.col("first"), moved).otherwise(F.col("doc_id")).alias("doc_id"), "shown", "text")


def substring_dedup(docs: DataFrame, window: int = 20, seed: int = 6) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts earlier.

    Earlier means a smaller ``doc_id``, or an earlier start in the same document; windows are judged on the input.
    Returns doc_id, n_words, n_removed, kept_text (kept words joined by one space) and repeats: the maximal repeats removed,
    each with its first word (from 0) and its number of words.

    Null and empty texts have no words: (0, 0, '').  Texts under ``window`` words keep all.  Rows that repeat a doc_id
    with the same text stand at the same place, so neither is earlier and both come back.  Of rows that repeat a doc_id with
    other texts, the first by a hash of the text stands at the id's place and the others after all documents; every
    row comes back.  Rows with a null doc_id stand before all others, those of one text at one place, and come back with a
    null doc_id.  Extra columns are ignored; an empty table gives an empty result.
    """
    # one filter for all branches, so that they share one exchange of the texts
    docs = _one_text_each(docs).where("doc_id is not null")
    searched = docs.mapInArrow(_fingerprints, _DDL["prints"]).where(F.col("n_words") >= window)
    keepers = searched.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    copies = searched.join(keepers, "doc_id", "left_anti")
    texts = docs.join(copies.select("doc_id"), "doc_id", "left_anti")

    anchors = texts.mapInArrow(_anchors(window, seed), _DDL["anchors"])
    again = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # joined on another value than the one they were counted by, both sides are exchanged for the join alone, and then
    # Spark splits the partition of an anchor that very many places share
    places = (
        anchors.select(F.bitwise_not("anchor").alias("key"), "doc_id", "at").join(again.select(F.bitwise_not("anchor").alias("key")), "key", "left_semi")
        .groupBy("doc_id").agg(F.collect_list("at").alias("places"))
    )

    first = F.min(F.struct("doc_id", "at")).alias("first")
    leaders = texts.join(places, "doc_id").mapInArrow(_stretches(window, seed), _DDL["stretches"]).groupBy("words").agg(first)
    listed = leaders.select("first", F.split("words", " ").alias("ws"))
    spelled = F.transform(F.sequence(F.lit(0), F.size("ws") - F.lit(window)), lambda o: F.array_join(F.slice("ws", o + 1, window), " "))
    windows = listed.select("first", F.posexplode(spelled).alias("o", "words")).select(
        F.xxhash64("words").alias("p1"), F.xxhash64(F.lit("other"), "words").alias("p2"), F.col("first.doc_id").alias("doc_id"), (F.col("first.at") + F.col("o")).alias("at")
    )
    firsts = windows.groupBy("p1", "p2").agg(first)

    cut = texts.join(places, "doc_id", "left").join(_listed(leaders, "leaders"), "doc_id", "left").join(_listed(firsts, "firsts"), "doc_id", "left").mapInArrow(_strip(window, seed), _DDL["kept"])
    copied = F.array(F.struct(F.lit(0).cast("long").alias("start"), "n_words"))
    out = cut.unionByName(copies.select("shown", "n_words", F.col("n_words").alias("n_removed"), F.lit("").alias("kept_text"), copied.alias("repeats")))
    return out.select(F.col("shown").alias("doc_id"), "n_words", "n_removed", "kept_text", "repeats")
