"""Divergence of sources against plain counting, and the trees against plain counting of count pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from lectern.llm.divergence import Trees, audit_sources, share

from .fixtures import awkward, empty

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
DDL = "doc_id long, text string, lang string, source string, term string, n long, value long, rank int, total long"


def plain(rows, least=3, top=200):
    groups, in_docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = TERM.findall((text or "").translate(LOWER))
        groups[lang or "", source or ""].update(found)
        in_docs[lang or ""].update(set(found))
    out = []
    p = lambda n, m: 1 + 10**9 * (n + 1) // m
    for (lang, source), c in groups.items():
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        total = {t: sum(g[t] for (k, _), g in groups.items() if k == lang) for t in kept}
        size = {s: sum(g[t] for t in kept) + len(kept) for (k, s), g in groups.items() if k == lang}
        pairs = []
        for (k, s), g in groups.items():
            if k == lang and s != source:
                pairs.append((-sum((p(c[t], size[source]) - p(g[t], size[s])) ** 2 // p(g[t], size[s]) for t in kept), s))
        out += [(lang, source, "pair", s, -x, i) for i, (x, s) in enumerate(sorted(pairs, key=lambda y: (y[0], y[1].encode())), 1)]
        terms = []
        for t in kept:
            a, b = p(c[t], size[source]), p(total[t], sum(total.values()) + len(kept))
            if c[t] and a > b:
                terms.append((-((a - b) ** 2 // b), t))
        out += [(lang, source, "term", t, -x, i) for i, (x, t) in enumerate(sorted(terms, key=lambda y: (y[0], y[1].encode()))[:top], 1)]
    return sorted(map(repr, out))


def audited(df, **options):
    return sorted(repr(tuple(r)) for r in audit_sources(df, **options).collect())


def prose(rng, n, langs=2, sources=7, vocabulary=60):
    words = [w for i in range(vocabulary) for w in (f"w{chr(97 + i % 26)}{chr(97 + i // 26)}", f"É{chr(200 + i)}")]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for _ in range(n):
        lang, source = f"l{rng.randrange(langs)}", rng.choice(["hot"] * 4 + [f"s{i}" for i in range(sources)])
        text = " ".join(rng.choice([w, w.upper(), w + "-x9" + w]) for w in rng.choices(words, weights, k=rng.randrange(30)))
        rows.append((text, lang, source))
    return rows


@pytest.mark.parametrize("options", [{}, {"terms_per_block": 4, "sources_per_bucket": 2}, {"terms_per_block": 1000, "sources_per_bucket": 3, "top_terms": 5}])
def test_every_pair_and_term(spark, options):
    rows = prose(random.Random(7), 250)
    df = spark.createDataFrame([(i, t, k, s, "x", 1, 2, 3, 4) for i, (t, k, s) in enumerate(rows)], DDL).repartition(3)
    assert audited(df, **options) == plain(rows, top=options.get("top_terms", 200))


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = [(r["text"], r["lang"], r["source"]) for r in df.collect()]
    extra = [("a b c", "x", "one"), ("d e f", "x", "two"), ("", "x", None), (None, "alone", "s"), ("a b", "alone", "s"), *[("same same Same", "y", "s")] * 3, (None, "y", "t"), ("z", "y", "")]
    more = df.unionByName(spark.createDataFrame([(i, t, k, s, 1, 1, 1, "c", "d", 0.5, 1) for i, (t, k, s) in enumerate(extra)], df.schema))
    for options in ({}, {"terms_per_block": 1, "sources_per_bucket": 1}, {"least_docs": 1}):
        assert audited(more, **options) == plain(rows + extra, least=options.get("least_docs", 3))


def test_empty_table(spark):
    out = audit_sources(empty(spark))
    assert out.count() == 0 and out.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_trees_share_nodes_and_count_every_term():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 3, (9, 37)) * (rng.random((9, 37)) < 0.3)
    counts[4] = counts[2]
    trees = Trees(counts)
    assert trees.roots[4] == trees.roots[2] and len(set(trees.roots)) == 8
    i, j = np.triu_indices(9, 1)
    pair, a, b, n = trees.pairs_of_counts(i, j)
    got = Counter({(p, x, y): t for p, x, y, t in zip(pair.tolist(), a.tolist(), b.tolist(), n.tolist())})
    assert len(got) == len(pair) and got == Counter((k, *map(int, x)) for k, (p, q) in enumerate(zip(i, j)) for x in zip(counts[p], counts[q]))
    assert share(np.array([0, 4 * 10**12]), np.array([7, 5 * 10**12])).tolist() == [1 + 10**9 // 7, 1 + 10**9 * (4 * 10**12 + 1) // (5 * 10**12)]
