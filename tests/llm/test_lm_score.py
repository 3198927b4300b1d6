"""Scores against a plain recursive model over whole counts, and the automaton's probabilities against their sum."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from lectern.llm.lm_score import Automaton, Grams, score_texts
from pyspark.sql import functions as F

from .fixtures import awkward, empty

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
DDL = "doc_id long, text string, lang string, chunk int, words string, held_out string, score double, bucket int, whole long"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [""]


class Plain:
    def __init__(self, texts, order, mass):
        self.n, self.order, self.mass = Counter(), order, mass
        for text in texts:
            seen = [" ", *tokens(text)]
            self.n.update(tuple(seen[i : i + m]) for m in range(1, order + 1) for i in range(len(seen) - m + 1))
        single = {g[0]: c for g, c in self.n.items() if len(g) == 1 and g != (" ",)}
        self.total, self.types = sum(single.values()), len(single)

    def p(self, context, word):
        if not context:
            return (self.n[(word,)] + 1) / (self.total + self.types + 1)
        return (self.n[(*context, word)] + self.mass * self.p(context[1:], word)) / (self.n[context] + self.mass)

    def scores(self, text):
        seen = [" ", *tokens(text)]
        base = sum(math.log10(self.p((), w)) for w in seen[1:])
        whole = sum(math.log10(self.p(tuple(seen[max(0, i - self.order + 1) : i]), seen[i])) for i in range(1, len(seen)))
        return len(seen) - 1, sum(self.n[(w,)] > 0 for w in seen[1:]), self.total, base, whole


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def check(df, **options):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    model = Plain([t for d, t in rows if not fold(d)], options.get("order", 2), options.get("mass", 2.0))
    want = sorted((repr(d), fold(d), *model.scores(t)) for d, t in rows)
    got = sorted((repr(r[0]), *r[1:]) for r in score_texts(df, held, **options).collect())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)
    return model


def prose(rng, n, most=80, vocabulary=200):
    weights = [1 / (i + 1) for i in range(vocabulary)]
    return [" ".join(rng.choice([f"w{w}", f"W{w}", f"w{w},\n", f"é{w}"]) for w in rng.choices(range(vocabulary), weights, k=rng.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"order": 1}, {"order": 3, "mass": 0.7}, {"chunk_bytes": 2000}, {"order": 3, "chunk_bytes": 3000}])
def test_every_text(spark, options):
    rng = random.Random(5)
    texts = prose(rng, 150) + [" ".join(prose(rng, 40))]
    check(spark.createDataFrame([(i, t, "x", 1, "w", "h", 0.5, 3, 4) for i, t in enumerate(texts)], DDL).repartition(3), **options)


def test_awkward_rows(spark):
    df = awkward(spark)
    more = df.unionByName(spark.createDataFrame([(None, "one two", *[None] * 9), (None, "one two", *[None] * 9), (3, None, *[None] * 9), (4, "\x1f A a\x85b  ", *[None] * 9)], df.schema))
    check(more)
    check(more, order=3, chunk_bytes=1 << 10)
    check(df.where("doc_id is null"))
    assert score_texts(empty(spark), F.lit(False)).count() == 0


def test_without_training_every_token_is_certain(spark):
    out = score_texts(awkward(spark), F.lit(True)).collect()
    assert all(r["base_score"] == 0 and r["score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in out)


def test_a_state_shares_out_all_probability():
    texts = pa.array(["a b c a b", "b c", "a c b a"])
    grams = Grams(texts, 3)
    counts = [np.bincount(grams.word, minlength=len(grams.words)), *(np.bincount(at[at >= 0], minlength=len(h)) for at, h in zip(grams.at, grams.hash))]
    tokens = int(len(grams.word) - 3)
    model = Automaton(grams, counts[0], counts[1:], tokens, len(grams.words) - 1, 2.0)
    known = np.array([i for i in range(len(grams.words)) if i != grams.begin])
    unseen = 1 / (tokens + len(known) + 1)
    for state in range(len(model.price)):
        price, at = 0.0, state
        while at:
            price, at = price + model.price[at], int(model.fail[at])
        last = state - 1 if state <= len(grams.words) else grams.last[0][state - 1 - len(grams.words)]
        if state and last == grams.end:
            continue  # nothing follows an end
        _, cost = model.step(np.full(len(known), state), known)
        assert (10**cost).sum() + unseen * 10**price == pytest.approx(1)


def test_lanes_carry_the_state():
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(30)}" for _ in range(3000))
    for order in (2, 3):
        grams = Grams(pa.array([text, "w1"]), order)
        counts = [np.bincount(grams.word, minlength=len(grams.words)), *(np.bincount(at[at >= 0], minlength=len(h)) for at, h in zip(grams.at, grams.hash))]
        model = Automaton(grams, counts[0], counts[1:], 3003, 31, 2.0)
        state, total = np.array([model.start]), 0.0
        for w in grams.word[1 : grams.ends[0] + 1]:
            state, cost = model.step(state, np.array([w]))
            total += cost[0]
        assert model.traverse(grams, order)[0] == pytest.approx(total)
