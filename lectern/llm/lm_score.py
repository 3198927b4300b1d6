"""Scores of texts under a weighted backoff automaton of the corpus's own n-grams.

States are the contexts that the training texts have; an arc reads a word and carries the smoothed log-probability of the
n-gram; where a state has no arc for a word, its failure arc gives up the first word of the context at a price.  One
traversal from left to right carries the state and adds up what the arcs and failure arcs cost.

Smoothing is Bayesian: p(w | h) = (c(hw) + mass * p(w | h')) / (c(h) + mass), where h' is h without its first word, down to
single words with one count more than they have (and one for all that were never seen).  Then p(w | h) of an n-gram
that was not seen is mass / (c(h) + mass) times p(w | h'), which is just a failure arc, and counts are all the model needs.

The model grows with the corpus and is in no place as a whole.  Texts are dealt into chunks; each chunk asks for the n-grams
of its own texts, once each and with its own counts, by buckets of their hash; a bucket adds up what all chunks have and
answers in the order of the question.  With the answers a chunk builds the part of the automaton that its texts can reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import BLANK, Words, mix

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: No word is empty or has a blank: the end of a text counts as a token, its beginning is only a context.
END, BEGIN = "", " "
LANE = 512  # words that one lane of a traversal reads
KEPT_BYTES = 5  # of an n-gram's hash, beside the part of it that chose the bucket
ASKED = "bucket int, chunk int, words string, word_n binary, grams binary, gram_n binary"
TOLD = "chunk int, bucket int, word_n binary, gram_n binary, tokens long, types long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def packed(counts: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs; the first byte says how many."""
    kind = np.min_scalar_type(counts.max(initial=0))
    return bytes([kind.itemsize]) + counts.astype(kind).tobytes()


def unpacked(packs: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(b, f"u{b[0]}", offset=1) for b in packs.to_pylist()]


def short(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES].tobytes()


def lengthened(packs: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for b in packs.to_pylist():
        wide = np.zeros((len(b) // KEPT_BYTES, 8), np.uint8)
        wide[:, :KEPT_BYTES] = np.frombuffer(b, np.uint8).reshape(-1, KEPT_BYTES)
        out.append(wide.view(np.uint64).ravel())
    return out


class Grams:
    """The tokens of some texts, and their n-grams of 2 to ``order`` tokens without repeats.

    A text is the tokens BEGIN, its words, END.  ``word`` has the place of each token in ``words``; level m - 2 of ``at``
    has, for each token, the number of the n-gram of m tokens that ends there (-1 where the text has too few before it).
    """

    def __init__(self, texts: pa.Array, order: int):
        found = Words(texts, hashed=False, fold=LOWER)
        rows = np.arange(found.rows)
        self.starts = found.row_from[:-1] + 2 * rows  # each text's BEGIN
        self.ends = found.row_from[1:] + 2 * rows + 1  # each text's END
        self.row = np.repeat(rows.astype(np.int32), found.counts + 2)
        size = len(self.row)
        bounds = np.zeros(len(found.starts) + 1, np.int64)
        np.cumsum(found.ends - found.starts, out=bounds[1:])
        held = found.data[~BLANK[found.data]]
        named = pa.LargeStringArray.from_buffers(len(found.starts), pa.py_buffer(bounds), pa.py_buffer(held)).dictionary_encode()
        del found, bounds, held
        sort = pc.sort_indices(named.dictionary).to_numpy()  # so that the order of the texts does not show
        place = np.empty(len(sort), np.int32)
        place[sort] = np.arange(2, len(sort) + 2)
        self.end, self.begin = 0, 1
        self.words = pa.concat_arrays([pa.array([END, BEGIN], pa.large_string()), named.dictionary.take(pa.array(sort))])
        self.word = np.full(size, -1, np.int32)
        self.word[self.ends], self.word[self.starts] = self.end, self.begin
        self.word[self.word < 0] = place[np.asarray(named.indices)]
        del named, sort, place
        self.word_hash = np.concatenate([mix(np.arange(1, 3, dtype=np.uint64)), Words(self.words.slice(2)).hash])
        self.at, self.prefix, self.last, self.suffix, self.hash = [], [], [], [], []
        before, before_hash, first = self.word, self.word_hash, np.zeros(size, bool)
        for m in range(2, order + 1):
            first[np.minimum(self.starts + m - 2, self.ends)] = True  # too few tokens before these
            here = np.flatnonzero(~first)
            once, of = np.unique(before[here - 1].astype(np.int64) * len(self.words) + self.word[here], return_inverse=True)
            now = np.full(size, -1, np.int32)
            now[here] = of
            suffix = np.empty(len(once), np.int32)
            suffix[of] = before[here]
            del of, here
            self.at.append(now)
            self.prefix.append((once // len(self.words)).astype(np.int32))
            self.last.append((once % len(self.words)).astype(np.int32))
            self.suffix.append(suffix)
            before_hash = mix(before_hash[self.prefix[-1]] * np.uint64(0x9E3779B97F4A7C15) + self.word_hash[self.last[-1]] + np.uint64(m))
            self.hash.append(before_hash)
            before = now

    def asked(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the words, and of the n-grams of all levels after each other, by bucket, with the buckets' bounds."""
        grams = np.concatenate(self.hash) if self.hash else np.zeros(0, np.uint64)
        by_hash = np.argsort(grams, kind="stable")
        out = []
        for hashes, order in ((self.word_hash, np.arange(len(self.word_hash))), (grams, by_hash)):
            bucket = ((hashes >> np.uint64(8 * KEPT_BYTES)) % np.uint64(buckets)).astype(np.int32)[order]
            sort = np.argsort(bucket, kind="stable")
            out += [order[sort], np.searchsorted(bucket[sort], np.arange(buckets + 1))]
        return tuple(out)


def _ask(order: int, buckets: int):
    def run(part: pa.Table) -> pa.Table:
        chunk = part["chunk"][0].as_py()
        grams = Grams(part["text"].combine_chunks(), order)
        learns = part["learns"].combine_chunks().to_numpy(zero_copy_only=False)[grams.row]
        word_n = np.bincount(grams.word[learns], minlength=len(grams.words))
        gram_n = [np.bincount(at[learns & (at >= 0)], minlength=len(level)) for at, level in zip(grams.at, grams.hash, strict=True)]
        words, word_cut, many, cut = grams.asked(buckets)
        hashes, gram_n = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (grams.hash, gram_n))
        named, word_n, hashes, gram_n = grams.words.take(pa.array(words)), word_n[words], hashes[many], gram_n[many]
        rows = []
        for b in np.flatnonzero((np.diff(word_cut) > 0) | (np.diff(cut) > 0)).tolist():
            w, g = slice(word_cut[b], word_cut[b + 1]), slice(cut[b], cut[b + 1])
            spelled = "\n".join(named[w].to_pylist()) if w.stop > w.start else None  # END alone is '', none is null
            rows.append((b, chunk, spelled, packed(word_n[w]), short(hashes[g]), packed(gram_n[g])))
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "chunk", "words", "word_n", "grams", "gram_n"])

    return run


def _tell(part: pa.Table) -> pa.Table:
    """Sums of a bucket over all chunks, in the order that each chunk asked for them."""
    words = pc.split_pattern(part["words"].combine_chunks(), "\n")
    word_cut = np.cumsum([0, *pc.fill_null(pc.list_value_length(words), 0).to_pylist()])
    named = words.flatten().dictionary_encode()
    place = np.asarray(named.indices)
    total = np.bincount(place, weights=np.concatenate(unpacked(part["word_n"])), minlength=len(named.dictionary)).astype(np.int64)
    token = np.asarray(pc.not_equal(named.dictionary, BEGIN))
    grams = lengthened(part["grams"])
    cut = np.cumsum([0, *map(len, grams)])
    _, of = np.unique(np.concatenate(grams), return_inverse=True)
    sums = np.bincount(of, weights=np.concatenate(unpacked(part["gram_n"]))).astype(np.int64)
    word_n, gram_n = ([packed(x[at[i] : at[i + 1]]) for i in range(part.num_rows)] for x, at in ((total[place], word_cut), (sums[of], cut)))
    tokens, types = np.zeros((2, part.num_rows), np.int64)
    tokens[0], types[0] = total[token].sum(), (total[token] > 0).sum()
    return pa.Table.from_arrays([part["chunk"], part["bucket"], *map(pa.array, (word_n, gram_n, tokens, types))], names=["chunk", "bucket", "word_n", "gram_n", "tokens", "types"])


class Automaton:
    """The part of the model that some texts can reach.

    State 0 has no context, the others are the contexts of one token and more that the training texts have.
    """

    def __init__(self, grams: Grams, word_n: np.ndarray, gram_n: list[np.ndarray], tokens: int, types: int, mass: float):
        self.width = len(grams.words)
        self.single = np.log10(word_n + 1.0) - np.log10(tokens + types + 1.0)  # arcs of state 0: all words have one
        order = len(gram_n) + 1
        held = [word_n, *gram_n]
        at = np.cumsum([1, *map(len, held)])  # the first state of each length
        seen = word_n > 0
        self.next_single = np.where(seen & (order > 1), at[0] + np.arange(self.width), 0)
        self.start = int(self.next_single[grams.begin])
        self.fail, self.price = np.zeros(at[order - 1], np.int64), np.zeros(at[order - 1])
        p, keys, weights, after = 10**self.single, [], [], []
        for m in range(2, order + 1):
            n, prefix, suffix, last = held[m - 1], grams.prefix[m - 2], grams.suffix[m - 2], grams.last[m - 2]
            p = (n + mass * p[suffix]) / (held[m - 2][prefix] + mass)
            there = n > 0
            keys.append((at[m - 2] + prefix[there].astype(np.int64)) * self.width + last[there])
            weights.append(np.log10(p[there]))
            after.append(at[m - 1] + np.flatnonzero(there) if m < order else at[m - 2] + suffix[there])
        for m in range(1, order):  # contexts of m tokens
            states = slice(at[m - 1], at[m])
            self.price[states] = np.log10(mass / (held[m - 1] + mass))
            if m > 1:
                self.fail[states] = at[m - 2] + grams.suffix[m - 2]
        keys = np.concatenate([*keys, np.zeros(0, np.int64)])
        sort = np.argsort(keys)
        self.keys, self.weights, self.after = keys[sort], np.concatenate([*weights, np.zeros(0)])[sort], np.concatenate([*after, np.zeros(0, np.int64)])[sort]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state after reading the word, log-probability) for many states at once."""
        cost, out, todo = np.zeros(len(state)), np.zeros(len(state), np.int64), np.arange(len(state))
        while len(todo):
            at, read = state[todo], word[todo]
            free = at == 0
            done = todo[free]
            cost[done] += self.single[word[done]]
            out[done] = self.next_single[word[done]]
            todo, at, read = todo[~free], at[~free], read[~free]
            key = at * self.width + read
            place = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            hit = self.keys[place] == key if len(self.keys) else np.zeros(len(key), bool)
            cost[todo[hit]] += self.weights[place[hit]]
            out[todo[hit]] = self.after[place[hit]]
            todo, at = todo[~hit], at[~hit]
            cost[todo] += self.price[at]
            state = state.copy()
            state[todo] = self.fail[at]
        return out, cost

    def traverse(self, grams: Grams, order: int) -> np.ndarray:
        """The log-probability of each text: lanes of some hundred tokens are read side by side, each from the state that the tokens before it lead to."""
        size = grams.ends - grams.starts  # tokens to read, the end among them
        lanes = -(-size // LANE)
        row = np.repeat(np.arange(len(size)), lanes)
        k = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        low = grams.starts[row] + 1 + k * LANE
        high = np.minimum(low + LANE, grams.ends[row] + 1)
        state, inside = np.where(k == 0, self.start, 0), np.flatnonzero(k > 0)
        for back in range(order - 1, 0, -1):
            state[inside], _ = self.step(state[inside], grams.word[low[inside] - back])
        total = np.zeros(len(row))
        by_length = np.argsort(low - high, kind="stable")
        low, high, state = low[by_length], high[by_length], state[by_length]
        for t in range(int((high - low).max(initial=0))):
            n = int(np.searchsorted(low - high, -t))  # lanes that have a token left
            state[:n], cost = self.step(state[:n], grams.word[low[:n] + t])
            total[:n] += cost
        return np.bincount(row[by_length], weights=total, minlength=len(size))


def _score(order: int, buckets: int, mass: float):
    def run(part: pa.Table, told: pa.Table) -> pa.Table:
        grams = Grams(part["text"].combine_chunks(), order)
        words, word_cut, many, cut = grams.asked(buckets)
        word_n, gram_n = np.zeros(len(words), np.int64), np.zeros(len(many), np.int64)
        for b, w, g in zip(told["bucket"].to_pylist(), unpacked(told["word_n"]), unpacked(told["gram_n"]), strict=True):
            word_n[words[word_cut[b] : word_cut[b + 1]]] = w
            gram_n[many[cut[b] : cut[b + 1]]] = g
        del words, many
        tokens, types = told["all_tokens"][0].as_py(), told["all_types"][0].as_py()
        levels = np.split(gram_n, np.cumsum([len(h) for h in grams.hash])[:-1]) if grams.hash else []
        model = Automaton(grams, word_n, levels, tokens, types, mass)
        read = grams.word != grams.begin
        row, n = grams.row[read], word_n[grams.word[read]]
        size, texts = grams.ends - grams.starts, len(grams.starts)
        base = np.bincount(row, weights=np.log10(n + 1.0), minlength=texts) - size * np.log10(tokens + types + 1.0)
        columns = [
            part["doc_id"], part["held_out"], pa.array(size), pa.array(np.bincount(row, weights=n > 0, minlength=texts).astype(np.int64)),
            pa.array(np.full(texts, tokens)), pa.array(base), pa.array(model.traverse(grams, order)),
        ]
        return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, held_out: Column, order: int = 2, mass: float = 2.0, chunk_bytes: int = 16 << 20) -> DataFrame:
    """Log-probability (base 10) of every whole text under n-grams of up to ``order`` tokens of the texts not ``held_out``.

    Tokens are words between ASCII blanks with A to Z lower-cased, then one end of the text.  Returns doc_id, held_out,
    n_tokens, n_known (tokens that training has), train_tokens (tokens of training), base_score (the sum over single
    tokens, each with one count more) and score (the automaton's).  Single words are counted by their text, n-grams by
    some 40 bits of a hash within their bucket, which stays as full however large the corpus is.

    Null and empty texts have the end alone.  Rows that repeat a doc_id are texts of their own; null ids stay null.  A null
    ``held_out`` is no.  Without training texts every token has probability 1.  Other columns are ignored; an empty
    table gives an empty result.  Chunks hold about ``chunk_bytes`` of text, or one text that is longer.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0]
    if size is None:
        return spark.createDataFrame([], SCORED)
    chunks = -(-size // chunk_bytes)
    buckets = 2 * chunks
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", F.length("text"), F.substring("text", 1, 64)), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", "held_out", (~F.col("held_out")).alias("learns"), "text")
    told = dealt.groupBy("chunk").applyInArrow(_ask(order, buckets), ASKED).groupBy("bucket").applyInArrow(_tell, TOLD)
    whole = told.agg(F.struct(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).alias("whole")).scalar()
    answers = told.select("chunk", "bucket", "word_n", "gram_n", whole["tokens"].alias("all_tokens"), whole["types"].alias("all_types"))
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(order, buckets, mass), SCORED)
