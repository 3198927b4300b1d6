"""Benchmark decontamination: latent semantic retrieval of benchmark items in passages, then checks on the words.

1. Documents are read as passages of two neighbouring blocks of ``BLOCK`` words.  Document frequencies of hashed words over
   all blocks of all texts give the TF-IDF weights.
2. A randomised SVD of the TF-IDF rows of the items and of all blocks of all documents gives the latent space.  Columns are
   the items' words, as no other word can bring a passage nearer to an item.  The scan that counts the frequencies counts each
   two columns over all blocks too (weights come after, as a column has one); the rounds of subspace iteration multiply by
   this table, not by the texts again.
3. Every passage of every text is projected and compared with all items by one matrix product.
4. Beside the cosine, a passage is a candidate of every item that it may share a run of words with: three words for items of
   eight and more, which any copy with at most a fifth of its words changed or left out has, the whole item for shorter
   ones.  These are looked up exactly, as no threshold is safe for a short item in a passage of rarer words.
5. Candidates by cosine or run are checked in the same task, where the text is at hand: longest common subsequence of
   words against the item's length, and for paraphrases whether the item's answer (its last words) is there too.

Items go to the tasks in blocks of ``items_at_once`` at most, and of no more than the rank has directions for, so no item is
lost in the projection and what is broadcast is bounded however long the benchmark is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, doc_key, only, shown_id, written
from .words import FOLDED, Words, text_slices

BLOCK = 32
BUCKETS = 1 << 17
RUN = 3  # words in a row that make a passage a candidate of an item
SHORT = 8  # items under so many words must stand in a text whole
SPARE = 32  # directions of the latent space beside one for each item
_MASK = np.uint64(BUCKETS - 1)


def _blocks(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Block number of every word (numbers run on over the slice), and the number of a row's first block."""
    per_row = -(-words.counts // BLOCK)
    first = np.concatenate([[0], np.cumsum(per_row)])
    inside = np.arange(len(words.row)) - words.row_from[words.row] if len(words.row) else np.zeros(0, np.int64)
    return first[words.row] + inside // BLOCK, first


def _block_frequencies(words: Words) -> tuple[np.ndarray, int]:
    """The bucket of each hashed word of each block of a slice, once a block; the number of blocks."""
    block, first = _blocks(words)
    # blocks of a slice are few: in 32 bits, unless one very long text is a slice by itself
    kind = np.uint32 if int(first[-1]) * BUCKETS <= 1 << 32 else np.int64
    seen = np.sort(block.astype(kind) * kind(BUCKETS) + (words.hash & _MASK).astype(kind))
    fresh = np.ones(len(seen), dtype=bool)
    fresh[1:] = seen[1:] != seen[:-1]
    return (seen[fresh] % kind(BUCKETS)).astype(np.int64), int(first[-1])


def _packed(part: int, first: int, place: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(part, first, places, whole numbers at them), few to a row, so that a batch of rows is small."""
    rows = []
    for at in range(0, len(place), PACKED):
        some = times[at : at + PACKED].astype(np.uint64)
        rows.append((place[at : at + PACKED].astype("<u4").tobytes(), some.astype(np.min_scalar_type(some.max()).newbyteorder("<")).tobytes()))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), pa.array([first] * len(rows), pa.int32()), *(pa.array(x, pa.binary()) for x in zip(*rows, strict=True))], names=["part", "first", "place", "times"])


def _totals(batches: Iterator[pa.RecordBatch], places: Callable[[int, int], int]) -> dict[tuple[int, int], np.ndarray]:
    """The packed rows of a task added up, by part and first; ``places`` tells how many places there are."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for part, first, place, times in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "place", "times")), strict=True):
            if (part, first) not in total:
                total[part, first] = np.zeros(places(part, first))
            at = np.frombuffer(place, "<u4")
            total[part, first][at] += np.frombuffer(times, f"<u{len(times) // len(at)}")  # places of a row are distinct
    return total


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (_, first), table in _totals(batches, lambda part, first: SPAN).items():
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array((first + some).astype(np.int32)), pa.array(table[some].astype(np.int64))], names=["bucket", "df"])


def inverse_frequencies(docs: DataFrame, counts: DataFrame | None = None) -> np.ndarray:
    """Weight of each hashed word by the blocks of the whole corpus that hold it (BUCKETS numbers reach the driver).

    ``counts`` are those of ``column_counts`` with frequencies, where they are at hand.
    """
    counts = column_counts(docs, [], frequencies=True) if counts is None else counts
    sums = counts.where(F.col("part") == FREQUENCIES).repartition(8, "first").mapInArrow(_frequencies, "bucket int, df long").toArrow()
    bucket, count = (sums.column(c).to_numpy() for c in ("bucket", "df"))
    df = np.zeros(BUCKETS + 1)
    df[bucket] = count
    return np.log((df[BUCKETS] + 1) / (df[:BUCKETS] + 1)).astype(np.float32) + 0.1


@dataclass
class Items:
    """A block of benchmark items in the latent space."""

    ids: np.ndarray
    words: list[np.ndarray]  # hash of each word of an item
    weights: np.ndarray  # of all hashed words
    column_hash: np.ndarray  # sorted hashes of the items' words
    basis: np.ndarray  # columns x rank
    latent: np.ndarray  # items x rank, rows of length 1 at most
    nearness: np.ndarray  # columns x items: what a word of a passage adds to its product with each item in the latent space
    most: np.ndarray  # the largest of each column
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by length: sorted hashes, item and place in it of each
    places: list[np.ndarray]  # column of each word of an item

    def columns(self, hashes: np.ndarray) -> np.ndarray:
        """Column of each word; -1 for words that no item has."""
        if not len(self.column_hash):
            return np.full(len(hashes), -1)
        lookup = np.zeros(BUCKETS, dtype=bool)
        lookup[(self.column_hash & _MASK).astype(np.int64)] = True
        out = np.full(len(hashes), -1)
        maybe = np.flatnonzero(lookup[(hashes & _MASK).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.column_hash, hashes[maybe]), len(self.column_hash) - 1)
        same = self.column_hash[at] == hashes[maybe]
        out[maybe[same]] = at[same]
        return out


def _rows(items: Items, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Block, column and weight of each word that has a column; the number of blocks."""
    block, first = _blocks(words)
    col = items.columns(words.hash)
    hit = np.flatnonzero(col >= 0)
    return block[hit], col[hit], items.weights[(words.hash[hit] & _MASK).astype(np.int64)], int(first[-1])


def _sums(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sum of the rows of each; the keys come sorted."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(rows, starts, axis=0) if len(keys) else rows


def _project(block: np.ndarray, col: np.ndarray, weight: np.ndarray, matrix: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Rows of the sparse block matrix, for the sorted distinct ``blocks``, times ``matrix``; the words come block by block."""
    out = np.zeros((len(blocks), matrix.shape[1]), dtype=np.float32)
    padded = np.vstack([matrix, np.zeros((1, matrix.shape[1]), dtype=matrix.dtype)])  # a place without a word has the last row
    start = np.searchsorted(block, blocks)
    for at in range(0, len(blocks), CHUNK):
        some = start[at : at + CHUNK]
        words = slice(some[0], np.searchsorted(block, blocks[at : at + CHUNK][-1], side="right"))
        row = np.searchsorted(blocks[at : at + CHUNK], block[words])
        place = np.arange(words.start, words.stop) - some[row]
        cols, weights = np.full((len(some), BLOCK), len(matrix)), np.zeros((len(some), 1, BLOCK), dtype=np.float32)
        cols[row, place], weights[row, 0, place] = col[words], weight[words]
        out[at : at + CHUNK] = (weights @ padded[cols])[:, 0]
    return out


def _pair_counts(block: np.ndarray, col: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys i * columns + j, i <= j, and for each the sum over the blocks of i's words there times j's."""
    words = np.sort(block * columns + col)
    first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else words
    times = np.diff(first, append=len(words))
    block, col = words[first] // columns, words[first] % columns
    keys = [np.zeros(0, np.int64)]
    for apart in range(BLOCK):  # places of two columns of one block
        same = np.flatnonzero(block[: len(block) - apart] == block[apart:])
        if not len(same):
            break
        keys.append(np.repeat(col[same] * columns + col[same + apart], times[same] * times[same + apart]))
    keys = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else keys
    return keys[first], np.diff(first, append=len(keys))


class _Pairs:
    """Sums of the products of two columns: a square of numbers for few columns, else sorted keys that are merged."""

    def __init__(self, columns: int):
        self.columns, self.square = columns, columns * columns <= DENSE
        self.key, self.value = np.zeros(0, np.int64), np.zeros(columns * columns if self.square else 0)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, key: np.ndarray, value: np.ndarray) -> None:
        if self.square:
            np.add.at(self.value, key, value)
            return
        self.new.append((key, value))
        self.waiting += len(key)
        if self.waiting > PAIRS:
            self.merge()

    def merge(self) -> None:
        if not self.new:
            return
        key, value = (np.concatenate(x) for x in zip((self.key, self.value), *self.new, strict=True))
        self.new, self.waiting = [], 0
        order = np.argsort(key, kind="stable")
        self.key, self.value = _sums(key[order], value[order])

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        key = np.flatnonzero(self.value) if self.square else self.key
        out = key, self.value[key] if self.square else self.value
        self.__init__(self.columns)
        return out


def _column_counts(shared, frequencies: bool):
    """Packed rows: for each block of items (part), the pairs of columns i <= j of a task's blocks, by the first of ROWS columns.

    A count is of the words of i in a block times those of j, a whole number; it stands at place (i - first) * columns + j.
    With ``frequencies``, the blocks that hold each bucket of words come too, and their number in bucket BUCKETS.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_Pairs(len(items.column_hash)) for items in shared.value]
        df = np.zeros(BUCKETS + 1, dtype=np.int64)

        def entries(part: int) -> Iterator[pa.RecordBatch]:
            key, value = held[part].taken()
            columns = held[part].columns
            for first in range(0, columns, ROWS):
                some = slice(*np.searchsorted(key, [first * columns, (first + ROWS) * columns]))
                yield from _packed(part, first, key[some] - first * columns, value[some])

        for batch in batches:
            for piece in text_slices(batch):
                words = Words(column(piece, "text"), fold=FOLDED)
                if frequencies:
                    bucket, blocks = _block_frequencies(words)
                    df[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                    df[BUCKETS] += blocks
                for part, items in enumerate(shared.value):
                    block, col, _, blocks = _rows(items, words)
                    for at in range(0, blocks, PASSAGES):
                        some = slice(*np.searchsorted(block, [at, at + PASSAGES]))
                        held[part].add(*_pair_counts(block[some] - at, col[some], held[part].columns))
                    if len(held[part].key) > PAIRS:
                        yield from entries(part)
        for part in range(len(held)):
            yield from entries(part)
        for first in range(0, BUCKETS + 1, SPAN):
            some = np.flatnonzero(df[first : first + SPAN])
            yield from _packed(FREQUENCIES, first, some, df[first + some])

    return run


def column_counts(docs: DataFrame, blocks: list[Items], frequencies: bool = False) -> DataFrame:
    """Packed counts of each task over all blocks of all texts (see ``_column_counts``), in one scan."""
    shared = docs.sparkSession.sparkContext.broadcast(blocks)
    out = written(docs.mapInArrow(_column_counts(shared, frequencies), "part int, first int, place binary, times binary"), "counts")
    shared.destroy()
    return out


def _added(shared):
    """(part, i, j, value), both ways round, from the packed counts of all tasks, with the weights of both columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [len(items.column_hash) for items in shared.value]
        total = _totals(batches, lambda part, first: min(ROWS, columns[part] - first) * columns[part])
        for part, first in list(total):
            table, items = total.pop((part, first)), shared.value[part]
            weight = items.weights[(items.column_hash & _MASK).astype(np.int64)].astype(np.float64)
            place = np.flatnonzero(table)
            i, j = first + place // columns[part], place % columns[part]
            value, apart = table[place] * weight[i] * weight[j], i != j
            i, j, value = np.r_[i, j[apart]].astype(np.int32), np.r_[j, i[apart]].astype(np.int32), np.r_[value, value[apart]]
            for at in range(0, len(i), 1 << 16):
                some = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i[some]), part, np.int32)), pa.array(i[some]), pa.array(j[some]), pa.array(value[some])], names=["part", "i", "j", "value"])

    return run


def column_products(docs: DataFrame, blocks: list[Items], counts: DataFrame | None = None) -> DataFrame:
    """(part, i, j, value), the sum of x_i x_j over the TF-IDF rows x of all blocks of all texts, for each block of items.

    ``counts`` are those of ``column_counts`` for these blocks, where they are at hand.
    """
    spark = docs.sparkSession
    counts = column_counts(docs, blocks) if counts is None else counts
    shared = spark.sparkContext.broadcast(blocks)
    few = max(8, sum(len(items.column_hash) ** 2 for items in blocks) >> 21)  # about 2 M pairs to a task
    # counts grow with the tasks that scan the documents, so they are added up in as many as Spark is told to shuffle to
    many = max(few, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sums = counts.where(F.col("part") != FREQUENCIES).repartition(many, "part", "first").mapInArrow(_added(shared), "part int, i int, j int, value double")
    out = written(sums.repartition(few, "i"), "products")
    shared.destroy()
    return out


def _times(shared):
    """(i, partial sums over j of value times row j of the matrix at hand, as bytes)."""

    def products(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        i, j, value = (np.concatenate(x) for x in zip(*held, strict=True))
        names = np.unique(i)
        at, columns = np.searchsorted(names, i), len(shared.value)
        few = max(1, PAIRS // columns)  # rows that are held in full at once
        for first in range(0, len(names), few):
            some = np.flatnonzero((at >= first) & (at < first + few)) if len(names) > few else slice(None)
            rows = np.zeros((min(few, len(names) - first), columns))
            np.add.at(rows.reshape(-1), (at[some] - first) * columns + j[some], value[some])
            yield pa.RecordBatch.from_arrays([pa.array(names[first : first + few]), pa.array([row.tobytes() for row in rows @ shared.value], pa.binary())], names=["i", "product"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        waiting = 0
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("i", "j", "value")))
            waiting += batch.num_rows
            if waiting > 2 * PAIRS:
                yield from products(held)
                held, waiting = [], 0
        if waiting:
            yield from products(held)

    return run


def latent_basis(products: DataFrame, items: Items, item_rows: np.ndarray, rank: int, rounds: int = 2) -> np.ndarray:
    """Right singular vectors of the items' rows over the documents' rows, by randomised subspace iteration.

    ``products`` (i, j, value) holds the products of the columns over all documents.

    What an item has outside them is added, so that each keeps 99 % of its squared length at least.
    """
    spark, columns = products.sparkSession, len(items.column_hash)
    rank = min(rank, columns)
    q = np.linalg.qr(np.random.default_rng(5).standard_normal((columns, rank)))[0]
    # the items' own rows weigh as much as the documents', so that an item no passage resembles has its direction
    product = np.zeros((columns, rank))
    for _ in range(rounds + 1):
        shared = spark.sparkContext.broadcast(q)
        product = np.zeros((columns, rank))
        for r in products.mapInArrow(_times(shared), "i int, product binary").toLocalIterator():  # columns x rank numbers in all, a column in few parts
            product[r["i"]] += np.frombuffer(r["product"], "<f8")
        own = item_rows.T @ (item_rows @ q)
        scale = max(1.0, np.linalg.norm(product) / max(np.linalg.norm(own), 1e-12))
        product = product + 4 * scale * own
        q, _ = np.linalg.qr(product)
        shared.destroy()
    rest = item_rows - (item_rows @ q) @ q.T
    lost = (rest**2).sum(axis=1) > 0.01 * (item_rows**2).sum(axis=1)
    if lost.any():
        q, _ = np.linalg.qr(np.hstack([q, rest[lost].T]))
    return q.astype(np.float32)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit for each place of ``a``."""
    masks: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b.tolist():
        m = masks.get(w)
        if m is not None:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def _contains(whole: np.ndarray, piece: np.ndarray) -> bool:
    if len(piece) > len(whole):
        return False
    return bool((np.lib.stride_tricks.sliding_window_view(whole, len(piece)) == piece).all(axis=1).any())


def judged(item: np.ndarray, weights: np.ndarray, region: np.ndarray, verbatim: float, paraphrase: float) -> tuple[float, bool, bool]:
    """(common subsequence / item length, answer found, contaminated) of an item and a stretch of a document."""
    ratio = common_subsequence(item, region) / len(item)
    answer = item[-max(3, len(item) // 4) :]
    # the answer is there if its telling words are, whatever stands between them
    telling = answer[weights[(answer & _MASK).astype(np.int64)] >= np.median(weights[(item & _MASK).astype(np.int64)])]
    found = bool(np.isin(telling, region).mean() >= 0.75) if len(telling) else False
    if len(item) < SHORT:
        return ratio, found, _contains(region, item)
    return ratio, found, ratio >= verbatim or (ratio >= paraphrase and found)


def _runs(words: Words) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The runs to look up for each item (rows with words, numbered in order), by their length."""
    number = np.cumsum(words.counts > 0) - 1
    length = np.where(words.counts < SHORT, words.counts, RUN)
    out = {}
    for n in np.unique(length[words.counts > 0]).tolist():
        row = words.row[: max(0, len(words.row) - n + 1)]
        at = np.flatnonzero(words.whole(n) & (length[row] == n))
        hashes, item, place = words.grams(n)[at], number[row[at]], at - words.row_from[row[at]]
        order = np.argsort(hashes, kind="stable")
        out[n] = hashes[order], item[order], place[order]
    return out


def _shared_runs(items: Items, words: Words, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (block, item), in order, such that the item stands from the block on if a run of it is a part of a copy."""
    n_items, found = len(items.ids), [np.zeros(0, np.int64)]
    for n, (hashes, item, place) in items.runs.items():
        grams = words.grams(n)
        lookup = np.zeros(BUCKETS, dtype=bool)
        lookup[(hashes & _MASK).astype(np.int64)] = True
        at = np.flatnonzero(lookup[(grams & _MASK).astype(np.int64)] & words.whole(n))
        low, high = (np.searchsorted(hashes, grams[at], side=side) for side in ("left", "right"))
        at, low, times = at[high > low], low[high > low], (high - low)[high > low]
        for some in range(0, len(at), 1 << 14):
            few = slice(some, some + (1 << 14))
            word, many = np.repeat(at[few], times[few]), times[few]
            entry = np.repeat(low[few] - (np.cumsum(many) - many), many) + np.arange(len(word))
            start = np.maximum(word - place[entry], words.row_from[words.row[word]])
            found.append(np.unique(block[start] * n_items + item[entry]))
    pairs = np.unique(np.concatenate(found))
    return pairs // n_items, pairs % n_items


_FOUND_DDL = "doc_id long, item_id long, cosine double, lcs_ratio double, answer_found boolean"


CHUNK = 1 << 7  # blocks whose rows of numbers are added up at once
PASSAGES = 4096  # passages that are projected at once
DENSE = 1 << 23  # pairs of columns that are held as a square
PAIRS = 1 << 20  # pairs of columns that are merged at once
ROWS = 8  # columns whose pairs are added up in one table
SPAN = 1 << 12  # buckets of words that are added up in one table
PACKED = 512  # counts in a row between tasks
FREQUENCIES = -1  # the part of the counts that is of buckets of words


def _candidates(items: Items, words: Words, block: np.ndarray, row_of: np.ndarray, idf: np.ndarray, col: np.ndarray, least_cosine: float) -> Iterator[tuple[int, int, float]]:
    """(passage, item, cosine) of the passages near an item or sharing a run of words with it, in order."""
    blocks = len(row_of)
    mass = np.bincount(block, weights=idf**2, minlength=blocks + 1)
    has_column = np.flatnonzero(col >= 0)
    near = np.bincount(block[has_column], weights=idf[has_column] * items.most[col[has_column]], minlength=blocks + 1)
    paired = np.zeros(blocks, dtype=bool)  # the passage's second block is of the same row
    paired[:-1] = row_of[1:] == row_of[:-1]
    norm2 = mass[:-1] + np.where(paired, mass[1:], 0)
    inside = near[:-1] + np.where(paired, near[1:], 0)
    shared_by, shared_item = _shared_runs(items, words, block)
    possible = inside >= least_cosine * np.sqrt(norm2) - 1e-4  # each word at its nearest item bounds the product from above
    possible[shared_by] = True
    chosen = np.flatnonzero(possible)
    for at in range(0, len(chosen), PASSAGES):
        passages = chosen[at : at + PASSAGES]
        wanted = np.unique(np.concatenate([passages, passages[paired[passages]] + 1]))
        # blocks rise along the words, so those of this piece are one stretch
        few = has_column[np.searchsorted(block[has_column], wanted[0]) : np.searchsorted(block[has_column], wanted[-1], side="right")]
        few = few[np.isin(block[few], wanted)]
        z = _project(block[few], col[few], idf[few], items.nearness, wanted)
        at_own = np.searchsorted(wanted, passages)
        x = z[at_own]
        both = np.flatnonzero(paired[passages])
        x[both] += z[at_own[both] + 1]
        cosine = x / np.sqrt(norm2[passages])[:, None]
        candidate = cosine >= least_cosine
        mine = slice(*np.searchsorted(shared_by, [passages[0], passages[-1] + 1]))
        candidate[np.searchsorted(passages, shared_by[mine]), shared_item[mine]] = True
        hit, item = np.nonzero(candidate)
        yield from zip(passages[hit].tolist(), item.tolist(), cosine[hit, item].tolist(), strict=True)


def _checked(items: Items, words: Words, least_cosine: float, verbatim: float, paraphrase: float) -> dict[tuple[int, int], tuple[float, float, bool]]:
    """(row, item) of the contaminated texts of a slice: common subsequence, cosine, whether the answer is there."""
    block, first = _blocks(words)
    blocks = int(first[-1])
    best: dict[tuple[int, int], tuple[float, float, bool]] = {}
    if not blocks:
        return best
    longest = max(len(w) for w in items.words)
    least = min(verbatim, paraphrase)
    there = np.zeros(len(items.column_hash) + 1, dtype=bool)  # the last place is of words that no item has
    idf = items.weights[(words.hash & _MASK).astype(np.int64)]
    col = items.columns(words.hash)
    row_of = np.searchsorted(first, np.arange(blocks), side="right") - 1
    last, row, region, present = -1, 0, words.hash[:0], col[:0]
    for p, i, c in _candidates(items, words, block, row_of, idf, col, least_cosine):
        if p != last:
            last, row = p, int(row_of[p])
            start = words.row_from[row] + (p - first[row]) * BLOCK
            # half an item's length again, for words put in between
            stretch = slice(max(words.row_from[row], start - BLOCK), min(words.row_from[row + 1], start + BLOCK + max(2 * BLOCK, longest + longest // 2)))
            there[present] = False
            region, present = words.hash[stretch], col[stretch]
            there[present] = True
            there[-1] = False
        # the item's words that are there at all bound the common subsequence from above
        if np.count_nonzero(there[items.places[i]]) / len(items.places[i]) < least:
            continue
        ratio, found, bad = judged(items.words[i], items.weights, region, verbatim, paraphrase)
        if bad and (ratio, c) > best.get((row, i), (0, 0))[:2]:
            best[row, i] = (ratio, c, found)
    return best


def _search(shared, least_cosine: float, verbatim: float, paraphrase: float):
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                words = Words(column(part, "text"), fold=FOLDED)
                ids = column(part, "doc_id").to_pylist()
                for items in shared.value:
                    best = _checked(items, words, least_cosine, verbatim, paraphrase)
                    rows = [(ids[r], int(items.ids[i]), min(1.0, v[1]), v[0], v[2]) for (r, i), v in best.items()]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "cosine", "lcs_ratio", "answer_found"])

    return run


def _items(rows: list, weights: np.ndarray) -> tuple[Items, np.ndarray] | None:
    """A block of items without a basis, and their TF-IDF rows over their own words."""
    words = Words(pa.array([r["text"] for r in rows], pa.string()), fold=FOLDED)
    some = np.flatnonzero(words.counts)
    if not len(some):
        return None
    hashes = [words.hash[words.row_from[i] : words.row_from[i + 1]] for i in some]
    columns = np.unique(words.hash)
    table = np.zeros((len(some), len(columns)), dtype=np.float32)
    for k, h in enumerate(hashes):
        np.add.at(table[k], np.searchsorted(columns, h), weights[(h & _MASK).astype(np.int64)])
    ids = np.array([rows[i]["item_id"] for i in some], dtype=np.int64)
    return Items(ids, hashes, weights, columns, np.zeros((len(columns), 0), np.float32), np.zeros((len(some), 0), np.float32), np.zeros((len(columns), 0), np.float32), np.zeros(len(columns), np.float32), _runs(words), [np.searchsorted(columns, h) for h in hashes]), table


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    rank: int = 256,
    least_cosine: float = 0.2,
    verbatim: float = 0.8,
    paraphrase: float = 0.55,
    items_at_once: int = 512,
    words_at_once: int = 16_000,
    blocks_a_scan: int = 4,
    keyed: bool = False,
) -> DataFrame:
    """Pairs of documents and the benchmark items they hold: doc_id, item_id, cosine, lcs_ratio, answer_found.

    Words are compared without ASCII case and punctuation.  The latent space is fitted on all passages of all texts, frequencies
    are counted over all, and all passages are searched.  Null and empty
    texts, and items without words, match nothing; items under eight words must stand in the text whole.  Rows that repeat
    a doc_id or an item_id are judged each, and a pair is returned once.  Documents with a null doc_id are searched too: their
    pairs come back with a null doc_id, those of different texts apart.  Extra columns are ignored; empty tables give an
    empty result.  ``rank`` bounds the items of a block to what its directions can hold (``rank`` less ``SPARE``) and
    ``words_at_once`` the words of their texts (one item alone may have more); ``blocks_a_scan`` blocks are sent to the tasks
    at once and share one scan of the documents.  With ``keyed`` null ids come back as the keys that stand for them.
    """
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text").withColumn("doc_id", doc_key())
    benchmark = only(benchmark, "item_id", "text").where("item_id is not null and text is not null").distinct()
    sizes = benchmark.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.split("text", r"\s+"))).alias("words")).first()
    if not sizes["n"] or docs.isEmpty():
        return spark.createDataFrame([], _FOUND_DDL)
    parts = max(-(-sizes["n"] // max(1, min(items_at_once, rank - SPARE))), -(-sizes["words"] // words_at_once))
    # dealt by a hash, parts differ in size; half as many again leave room for that
    parts = parts if parts == 1 else parts + parts // 2
    ranked = benchmark.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    found = weights = None
    for at in range(0, parts, blocks_a_scan):
        texts = [ranked.where(F.col("part") == part).orderBy("item_id", "text").collect() for part in range(at, min(parts, at + blocks_a_scan))]
        unweighted = [built[0] for rows in texts if (built := _items(rows, np.zeros(BUCKETS, np.float32))) is not None]
        counts = column_counts(docs, unweighted, frequencies=weights is None)  # weights come from the first scan
        weights = inverse_frequencies(docs, counts) if weights is None else weights
        built_blocks = [built for rows in texts if (built := _items(rows, weights)) is not None]
        products = column_products(docs, [items for items, _ in built_blocks], counts)
        discard(counts)
        blocks = []
        for part, (items, table) in enumerate(built_blocks):
            items.basis = latent_basis(products.where(F.col("part") == part).drop("part"), items, table, len(items.ids) + SPARE)
            latent = table @ items.basis
            items.latent = (latent / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)
            items.nearness = items.basis @ items.latent.T  # a passage is projected and compared by one product
            items.most = np.maximum(items.nearness.max(axis=1), 0)
            blocks.append(items)
        shared = spark.sparkContext.broadcast(blocks)
        some = written(docs.mapInArrow(_search(shared, least_cosine, verbatim, paraphrase), _FOUND_DDL), "leaks")
        shared.destroy()
        found = some if found is None else found.unionByName(some)
    found = found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs_ratio").alias("lcs_ratio"), F.max("answer_found").alias("answer_found"))
    return found if keyed else found.withColumn("doc_id", shown_id(F.col("doc_id")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no benchmark item was found, with all their columns; those without a doc_id are judged too."""
    named = docs.withColumn("__key", doc_key())
    leaks = find_contamination(named.select(F.col("__key").alias("doc_id"), "text"), benchmark, keyed=True, **options)
    return named.join(leaks.select(F.col("doc_id").alias("__key")).distinct(), "__key", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
