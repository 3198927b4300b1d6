"""N-gram Jaccard join: MinHash bands find candidates, Bayesian pruning drops the hopeless, sets verify the rest exactly.

1. Each text becomes the set of its ``n``-word shingles.  Texts with equal sets are one class with one representative, so
   a group of copies, however large, is one row from here on.
2. Representatives meet in buckets of equal MinHash bands.  In a bucket, MinHash values are compared a few at a time and a
   pair is dropped once the posterior probability that its similarity reaches the threshold is under ``tolerance``.
   Pairs never leave the task: a bucket returns the forest that joins its surviving pairs.
3. Connected components of these forests bring representatives together with their full sets.  There pairs are pruned in the
   same way, as most of a long chain are, and the surviving ones verified exactly by a product of 0/1 matrices of their
   rows; what leaves is the number of links of each row and a forest.
Buckets and components of more rows or bytes than a block are dealt out as pairs of blocks, so no task gathers a whole large
group.  A component of n rows is copied n / ``block`` times: its links alone may be n squared, and each is counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, column, doc_key, only, shown_id, written
from .components import connected_components
from .words import Words, mix, text_slices

#: 28 bands of 4 values: a pair of similarity 0.8 shares none with probability (1 - 0.8**4)**28 = 4e-7.
BANDS, ROWS = 28, 4
_GENERATOR = np.random.default_rng(71)
_MULTIPLIERS = _GENERATOR.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _GENERATOR.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)

_SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set1", pa.int64()), ("set2", pa.int64()), ("bands", pa.list_(pa.int64())), ("values", pa.binary())])
_SKETCH_DDL = "doc_id long, n long, set1 long, set2 long, bands array<long>, values binary"


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-word shingles of each row, sorted within the row, and the row bounds.

    A text of fewer words than n has one shingle, all its words; one without words has none.
    """
    words = Words(texts)
    grams, whole = words.grams(n), words.whole(n)
    row, value = words.row[: len(grams)][whole], grams[whole]
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash * (np.arange(len(words.hash), dtype=np.uint64) - words.row_from[words.row].astype(np.uint64) + np.uint64(11)))])
        extra = mix(sums[words.row_from[short + 1]] - sums[words.row_from[short]])
        row, value = np.concatenate([row, short]), np.concatenate([value, extra])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[fresh], value[fresh]
    return value, np.searchsorted(row, np.arange(len(texts) + 1))


def _sketches(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                value, bounds = shingle_sets(column(part, "text"), n)
                sizes = np.diff(bounds)
                some = np.flatnonzero(sizes)
                ids = np.asarray(column(part, "doc_id"))[some]
                if not len(some):
                    continue
                at = bounds[some]
                low = np.empty((len(some), BANDS * ROWS), dtype=np.uint64)
                for i in range(BANDS * ROWS):
                    low[:, i] = np.minimum.reduceat((value ^ _SALTS[i]) * _MULTIPLIERS[i], at)
                keys = np.zeros((len(some), BANDS), dtype=np.uint64)
                for r in range(ROWS):
                    keys = mix(keys * np.uint64(31) + low[:, r::ROWS] + np.uint64(r))
                keys = mix(keys + np.arange(BANDS, dtype=np.uint64))
                values = (mix(low) & np.uint64(0xFFFF)).astype("<u2")
                set1, set2 = np.add.reduceat(mix(value), at), np.add.reduceat(mix(value ^ np.uint64(0xABCDEF)), at)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * BANDS, pa.int32()), pa.array(keys.ravel().view(np.int64)))
                yield arrow_batch(_SKETCH, [ids, sizes[some], set1, set2, bands, pa.array([v.tobytes() for v in values], pa.binary())])

    return run


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float, step: int = 16) -> tuple[tuple[int, int], ...]:
    """(values compared, fewest matches) at which P(similarity >= threshold | matches), uniform prior, is not under tolerance."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(step, BANDS * ROWS + 1, step):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(log - log.max())
            if density[grid >= threshold].sum() >= tolerance * density.sum():
                out.append((n, m))
                break
    return tuple(out)


def _forest(links: tuple[np.ndarray, np.ndarray], size: int) -> np.ndarray:
    """Root of each row under the given links; the root of a tree is its smallest row."""
    label = np.arange(size)
    a, b = links
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def pairs_of_cell(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows that a cell is to compare: a block's inner ones, or those across its two blocks."""
    if (own == other).all():
        return np.triu_indices(len(own), 1)
    left, right = np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min())
    return np.repeat(left, len(right)), np.tile(right, len(left))


def surviving_pairs(values: np.ndarray, threshold: float, tolerance: float, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs of rows (all, if none are named) that incremental comparison of their MinHash values does not rule out."""
    a, b = pairs or np.triu_indices(len(values), 1)
    done, matches = 0, np.zeros(len(a), dtype=np.int32)
    for n, least in least_matches(threshold, tolerance):
        for at in range(0, len(a), 1 << 16):
            some = slice(at, at + (1 << 16))
            matches[some] += (values[a[some], done:n] == values[b[some], done:n]).sum(axis=1)
        alive = matches >= least
        a, b, matches, done = a[alive], b[alive], matches[alive], n
    return a, b


def _streamed_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(column(batch, k)) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        cuts = [0, *np.flatnonzero(change), batch.num_rows]
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for x, y in zip(cuts, cuts[1:]):
            held.append(batch.slice(x, y - x))
            if y < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _blocked(rows: DataFrame, group: str, blocks: Column, seed: int) -> DataFrame:
    """Deal each group out as all pairs of its blocks: one pair where the group is one block."""
    blocks = blocks.cast("int")
    own = F.pmod(F.xxhash64("rep", F.lit(seed)), blocks).cast("int")
    return rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "own", "other", *rows.columns
    )


def _cells(rows: DataFrame, run: Callable, ddl: str) -> DataFrame:
    return rows.repartition("cell").sortWithinPartitions("cell", "rep").mapInArrow(run, ddl)


def _values(group: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(group.column("values").to_pylist()), dtype="<u2").reshape(group.num_rows, -1)


def _cell_pairs(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return pairs_of_cell(group.column("own").to_numpy(), group.column("other").to_numpy())


def _bucket_forests(threshold: float, tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst = [], []
        for group in _streamed_groups(batches, ("cell",)):
            if group.num_rows < 2:
                continue
            ids = group.column("rep").to_numpy()
            root = _forest(surviving_pairs(_values(group), threshold, tolerance, _cell_pairs(group)), len(ids))
            moved = np.flatnonzero(root != np.arange(len(ids)))
            src.append(ids[moved])
            dst.append(ids[root[moved]])
            if len(src) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])
                src, dst = [], []
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                value, bounds = shingle_sets(column(part, "text"), n)
                sets = [value[bounds[i] : bounds[i + 1]].tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([*(column(part, c) for c in ("doc_id", "component", "copies", "values")), pa.array(sets, pa.binary())], names=["rep", "component", "copies", "values", "shingles"])

    return run


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """|A and B| for every row A of ``left`` and B of ``right``, by products of 0/1 matrices over ``width`` shingles at a time."""
    value = np.concatenate([sets[i] for i in range(len(sets))])
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    names, place, times = np.unique(value, return_inverse=True, return_counts=True)
    common = np.flatnonzero(times > 1)  # a shingle of one row is in no intersection
    dense = np.full(len(names), -1)
    dense[common] = np.arange(len(common))
    keep = dense[place] >= 0
    row, place = row[keep], dense[place][keep]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    out = np.zeros((len(left), len(right)))
    for at in range(0, len(common), width):
        a, b = np.searchsorted(place, [at, at + width])
        matrix = np.zeros((len(sets), min(width, len(common) - at)), dtype=np.float32)
        matrix[row[a:b], place[a:b] - at] = 1
        out += matrix[left] @ matrix[right].T
    return out


def _verify(threshold: float, tolerance: float):
    names = ["rep", "linked", "nearest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[], [], []]
        for group in _streamed_groups(batches, ("cell",)):
            if group.num_rows < 2:
                continue
            a, b = surviving_pairs(_values(group), threshold, tolerance, _cell_pairs(group))
            if not len(a):
                continue
            ids, copies, shingles = group.column("rep").to_numpy(), group.column("copies").to_numpy(), group.column("shingles")
            some, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            sets = [np.frombuffer(shingles[i].as_buffer(), dtype=np.uint64) for i in some.tolist()]
            sizes = np.array([len(s) for s in sets])
            # the surviving pairs' rows only: one product has all their intersections
            x, y = place[: len(a)], place[len(a) :]
            (left, at_left), (right, at_right) = np.unique(x, return_inverse=True), np.unique(y, return_inverse=True)
            shared = shared_counts(sets, left, right)[at_left, at_right]
            linked = shared >= threshold * (sizes[x] + sizes[y] - shared) - 1e-9
            a, b = a[linked], b[linked]
            count = np.bincount(a, weights=copies[b], minlength=len(ids)) + np.bincount(b, weights=copies[a], minlength=len(ids))
            root = _forest((a, b), len(ids))
            hit = np.flatnonzero(count)
            for held, found in zip(out, (ids[hit], count[hit].astype(np.int64), ids[root[hit]]), strict=True):
                held.append(found)
            if len(out[0]) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=names)
                out = [[], [], []]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=names)

    return run


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, block: int = 512, block_bytes: int = 4 << 20, keyed: bool = False) -> DataFrame:
    """Link documents whose sets of n-word shingles have a Jaccard similarity of ``threshold`` or more.

    Returns one row per document: doc_id, rep_id (smallest doc_id with the same set), class_id (smallest doc_id of its
    connected component of links) and n_links (documents it is linked to, copies included).

    Words are runs of non-blank characters, unchanged.  Texts of one to n - 1 words have one shingle, all their words.
    Null texts and texts without words are linked to nothing, not even each other.  A row that repeats a doc_id counts as a
    copy where its set is the same.  Rows with a null doc_id stand before all others, those of one text as repeats of one id,
    and come back with null ids (``keyed``: with the keys that stand for them).  Extra columns are ignored; an empty table
    gives an empty result.  ``block`` rows and about ``block_bytes`` of shingle hashes bound each side of a cell.
    """
    docs = only(docs, "doc_id", "text").withColumn("doc_id", doc_key())
    sketches = written(docs.mapInArrow(_sketches(n), _SKETCH_DDL), "sketches")
    classes = written(sketches.groupBy("n", "set1", "set2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    of_reps = sketches.join(classes.select("rep", "set1", "set2"), (sketches.doc_id == F.col("rep")) & (sketches.set1 == classes.set1) & (sketches.set2 == classes.set2)).select("rep", "bands", "values").dropDuplicates(["rep"])

    entries = of_reps.select("rep", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = entries.join(shared, "bucket").join(of_reps.select("rep", "values"), "rep")
    forests = _cells(_blocked(met, "bucket", F.ceil(F.col("size") / block), 1), _bucket_forests(threshold, tolerance), "src long, dst long")
    candidates = connected_components(forests)

    placed = candidates.join(classes, F.col("node") == F.col("rep")).join(of_reps, "rep").select(F.col("rep").alias("doc_id"), "component", "copies", "n", "values")
    sizes = placed.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") * 8 / block_bytes)).alias("blocks"))
    sets = docs.join(placed.drop("n"), "doc_id").select("doc_id", "component", "copies", "values", "text").mapInArrow(_sets(n), "rep long, component long, copies long, values binary, shingles binary")
    cells = _blocked(sets.dropDuplicates(["rep"]).join(sizes, "component"), "component", F.col("blocks"), 2)
    verified = written(_cells(cells, _verify(threshold, tolerance), "rep long, linked long, nearest long"), "verified")

    links = verified.groupBy("rep").agg(F.sum("linked").alias("linked"))
    groups = connected_components(verified.select(F.col("rep").alias("src"), F.col("nearest").alias("dst")))
    known = (
        classes.join(links, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left")
        .select("set1", "set2", "rep", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    with_words = sketches.select("doc_id", "set1", "set2").join(known, ["set1", "set2"]).select("doc_id", F.col("rep").alias("rep_id"), "class_id", "n_links")
    alone = docs.join(sketches.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("rep_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    out = with_words.unionByName(alone)
    return out if keyed else out.select(*(shown_id(F.col(c)).alias(c) for c in ("doc_id", "rep_id", "class_id")), "n_links")
