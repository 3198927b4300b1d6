"""How far the sources of a language differ in their words: an audit over hash-consed segment trees.

The counts of every (language, source) group over the language's kept terms form a segment tree over term ids.  Trees are
built from the leaves up and equal subtrees of any groups are one node (two nodes of a level are the same if their
children are).  A pair of groups is priced by walking both trees at once from the roots: node pairs that come up more than
once are kept once with their number, so equal node pairs are walked, and equal pairs of counts priced, a single time.

A term's id is its block (a hash) and its place there by frequency, so blocks are built, walked and summed side by side and
no task holds a vocabulary; groups of a language meet in buckets of a few sources.  All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batch, column, only, written
from .words import Words, text_slices

PARTS = 1_000_000_000
TERM_BYTES = np.arange(256, dtype=np.uint8)
TERM_BYTES[65:91] += 32
TERM_BYTES[[i for i in range(128) if not chr(i).isalpha()]] = 0x20

COUNTED = "lang string, source string, term string, n long, docs long"
PAIRS_AT_ONCE = 64


def share(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (n + 1) / m), three digits at a time so that nothing overflows."""
    left, out = n + 1, np.zeros_like(n)
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // m, left % m
    return out + 1


def share_sql(n: str, m: str) -> str:
    """``share`` of two long columns, as an expression."""
    first = f"({n} + 1) * 1000"
    second = f"({first}) % {m} * 1000"
    third = f"({second}) % {m} * 1000"
    return f"(1 + (({first}) div {m}) * 1000000 + (({second}) div {m}) * 1000 + ({third}) div {m})"


def gap_sql(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of some MB of texts at a time, and a row of term '' for every group."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    for batch in batches:
        for part in text_slices(batch, limit=8 << 20):
            words = Words(column(part, "text"), hashed=False, fold=TERM_BYTES)
            lang, source = column(part, "lang").dictionary_encode(), column(part, "source").dictionary_encode()
            of_row = np.asarray(lang.indices).astype(np.int64) * len(source.dictionary) + np.asarray(source.indices)
            held = words.data[words.data != 0x20]
            at = np.zeros(len(words.starts) + 1, np.int64)
            np.cumsum(words.ends - words.starts, out=at[1:])
            terms = pa.LargeStringArray.from_buffers(len(words.starts), pa.py_buffer(at), pa.py_buffer(held)).dictionary_encode()
            many = max(1, len(terms.dictionary))
            in_doc, n = np.unique(words.row * many + np.asarray(terms.indices), return_counts=True)
            group, of = np.unique(of_row[in_doc // many] * many + in_doc % many, return_inverse=True)
            total = np.bincount(of, weights=n, minlength=len(group)).astype(np.int64)
            docs = np.bincount(of, minlength=len(group))
            seen = np.unique(of_row)
            g, t = np.concatenate([group // many, seen]), group % many
            term = pa.concat_arrays([terms.dictionary.take(pa.array(t)).cast(pa.string()), pa.array([""] * len(seen), pa.string())])
            spread = len(source.dictionary)
            yield arrow_batch(schema, (lang.dictionary.take(pa.array(g // spread)), source.dictionary.take(pa.array(g % spread)), term, np.concatenate([total, 0 * seen]), np.concatenate([docs, 0 * seen])))


class Trees:
    """Segment trees over the rows of a matrix of counts, equal subtrees of all rows being one node."""

    def __init__(self, counts: np.ndarray):
        height = max(0, int(counts.shape[1] - 1).bit_length())
        padded = np.full((len(counts), 1 << height), -1, np.int64)  # places without a term
        padded[:, : counts.shape[1]] = counts
        self.counts, nodes = np.unique(padded, return_inverse=True)
        nodes = nodes.reshape(padded.shape)
        self.left, self.right = [], []  # children of each level's nodes, the leaves' parents first
        while nodes.shape[1] > 1:
            width = int(nodes.max()) + 1
            both, nodes = np.unique(nodes[:, ::2] * width + nodes[:, 1::2], return_inverse=True)
            nodes = nodes.reshape(len(counts), -1)
            self.left.append(both // width)
            self.right.append(both % width)
        self.roots = nodes[:, 0]

    def pairs_of_counts(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pair, count in i, count in j, number of terms) of the pairs of trees, each combination once."""
        pair, a, b, n = np.arange(len(i)), self.roots[i], self.roots[j], np.ones(len(i), np.int64)
        for left, right in zip(reversed(self.left), reversed(self.right), strict=True):
            pair, n = np.tile(pair, 2), np.tile(n, 2)
            a, b = np.concatenate([left[a], right[a]]), np.concatenate([left[b], right[b]])
            width = int(max(a.max(), b.max())) + 1
            once, of = np.unique((pair * width + a) * width + b, return_inverse=True)
            n = np.bincount(of, weights=n, minlength=len(once)).astype(np.int64)
            pair, a, b = once // width // width, once // width % width, once % width
        there = self.counts[a] >= 0
        return pair[there], self.counts[a[there]], self.counts[b[there]], n[there]


PRICED = "lang string, source string, item string, value long, terms long"


def _priced(part: pa.Table) -> pa.Table:
    """Sums over one block of terms for every ordered pair of groups, one of the first bucket and one of the second."""
    rows = part.combine_chunks()
    sources = rows["source"].combine_chunks().dictionary_encode()
    at = np.asarray(sources.indices)
    whole, bucket = (np.zeros(len(sources.dictionary), np.int64) for _ in range(2))
    whole[at], bucket[at] = rows["whole"].to_numpy(), rows["bucket"].to_numpy()
    named = rows["term"].is_valid().to_numpy()
    terms = rows["term"].combine_chunks().filter(pa.array(named)).dictionary_encode()
    n, place = rows["n"].to_numpy()[named], np.asarray(terms.indices)
    order = np.argsort(-np.bincount(place, weights=n, minlength=len(terms.dictionary)), kind="stable")
    by_size = np.empty(len(order), np.int64)
    by_size[order] = np.arange(len(order))
    counts = np.zeros((len(sources.dictionary), len(order)), np.int64)
    counts[at[named], by_size[place]] = n
    lo, hi = rows["lo"][0].as_py(), rows["hi"][0].as_py()
    i, j = np.triu_indices(len(whole), 1)
    if lo != hi:
        across = bucket[i] != bucket[j]
        i, j = i[across], j[across]
    value = np.zeros((2, len(i)), np.int64)
    if counts.size:
        trees = Trees(counts)
        for start in range(0, len(i), PAIRS_AT_ONCE):
            one, other = i[start : start + PAIRS_AT_ONCE], j[start : start + PAIRS_AT_ONCE]
            pair, a, b, times = trees.pairs_of_counts(one, other)
            p, q = share(a, whole[one][pair]), share(b, whole[other][pair])
            for k, priced in enumerate(((p - q) ** 2 // q, (q - p) ** 2 // p)):
                np.add.at(value[k, start : start + PAIRS_AT_ONCE], pair, priced * times)
    names, both = sources.dictionary, (np.concatenate([i, j]), np.concatenate([j, i]))
    lang = pa.array([rows["lang"][0].as_py()] * (2 * len(i)), pa.string())
    return pa.Table.from_arrays([lang, names.take(pa.array(both[0])), names.take(pa.array(both[1])), pa.array(value.ravel()), pa.array(np.full(2 * len(i), len(order), np.int64))], names=["lang", "source", "item", "value", "terms"])


def _small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """To every task if it has few rows, dealt out otherwise."""
    return F.broadcast(df) if df.count() <= most else df


def audit_sources(docs: DataFrame, least_docs: int = 3, top_terms: int = 200, terms_per_block: int = 8192, sources_per_bucket: int = 32) -> DataFrame:
    """Divergences between the sources of a language ('pair') and the terms a source has most above its language ('term').

    Terms are runs of ASCII letters and characters beyond ASCII, A to Z lower-cased.  A language keeps the V terms that at
    least ``least_docs`` of its documents have.  With count occurrences of a kept term in a group and N of all of them, its
    share is p = 1 + floor(10**9 * (count + 1) / (N + V)); two shares differ by floor((p - q)**2 / q).  Returns lang, source,
    part, item, value, rank: for part 'pair' every other source of the language with the sum over all kept terms, for
    part 'term' the ``top_terms`` kept terms that the group has and whose share is above the language's.  Ranks go by value
    from the highest, then by item.

    Null text, lang and source are ''.  A group without terms is there with counts of 0; a language that keeps no term
    has pairs of value 0.  Repeated rows are documents of their own.  Other columns are ignored, an empty table gives an
    empty result.
    """
    rows = only(docs, "text", "lang", "source").select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    seen = written(rows.mapInArrow(_counted, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term_counts")
    kept = seen.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    counts = written(seen.where("term <> ''").drop("docs").join(kept, ["lang", "term"]), "kept_counts")

    groups = seen.where("term = ''").select("lang", "source")
    of_group = groups.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("size")), ["lang", "source"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    v = counts.groupBy("lang", "term").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    n = of_group.groupBy("lang").agg(F.sum("size").alias("lang_size"), F.count(F.lit(1)).alias("sources"))
    langs = n.join(v, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    numbered = of_group.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    known = written(
        numbered.join(langs, "lang").select(
            "lang", "source", "v", (F.col("size") + F.col("v")).alias("whole"), (F.col("lang_size") + F.col("v")).alias("lang_whole"), F.floor(F.col("no") / sources_per_bucket).alias("bucket"),
            F.ceil(F.col("sources") / sources_per_bucket).alias("buckets"), F.greatest(F.ceil(F.col("v") / terms_per_block), F.lit(1)).alias("blocks"),
        ), "groups",
    )
    of_term = counts.join(_small(known), ["lang", "source"])

    places = of_term.select("lang", "source", "term", "n", "whole", "bucket", "buckets", F.pmod(F.xxhash64("term"), "blocks").alias("block"))
    marks = known.select("lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "whole", "bucket", "buckets", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    met = places.unionByName(marks).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)))
    met = met.select("lang", "source", "term", "n", "whole", "bucket", "block", F.least("bucket", "other").alias("lo"), F.greatest("bucket", "other").alias("hi"))
    sums = met.groupBy("lang", "block", "lo", "hi").applyInArrow(_priced, PRICED).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    mine, theirs = known.select("lang", "source", "v", "whole"), known.select("lang", F.col("source").alias("item"), F.col("whole").alias("item_whole"))
    # terms that neither source's bucket has are all the same leaf: no occurrence on either side
    whole_sum = sums.join(_small(mine), ["lang", "source"]).join(_small(theirs), ["lang", "item"])
    rest = f"IF(v > terms, (v - terms) * {gap_sql(share_sql('0L', 'whole'), share_sql('0L', 'item_whole'))}, 0L)"
    pairs = whole_sum.select("lang", "source", F.lit("pair").alias("part"), "item", F.expr(f"value + {rest}").alias("value"))

    shares = of_term.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(share_sql("n", "whole")).alias("p"), F.expr(share_sql("total", "lang_whole")).alias("q"))
    terms = shares.where("p > q").select("lang", "source", "part", "item", F.expr(gap_sql("p", "q")).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    first = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_terms)
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(first)
