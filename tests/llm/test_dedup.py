"""Substring dedup, exact dedup and the Jaccard join against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from lectern.llm import components
from lectern.llm.common import written
from lectern.llm.components import connected_components
from lectern.llm.exact_dedup import build_fuse_filter, exact_dedup, probe_fuse_filter
from lectern.llm.jaccard_join import jaccard_join, least_matches, shared_counts, surviving_pairs
from lectern.llm.substring_dedup import substring_dedup
from pyspark.sql import functions as F

from .fixtures import awkward, empty, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stripped(rows, window=20):
    words = {d: WORD.findall(t or "") for d, t in rows}
    first = {}
    for d in sorted(words):
        for s in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][s : s + window]), (d, s))
    out = {}
    for d, ws in words.items():
        gone = set()
        for s in range(len(ws) - window + 1):
            if first[tuple(ws[s : s + window])] != (d, s):
                gone.update(range(s, s + window))
        out[d] = (len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone))
    return out


def check_substrings(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup(docs).collect()}
    assert got == stripped(rows)


def test_substring_awkward(spark):
    check_substrings(awkward(spark))


def test_substring_random_mixes(spark):
    rng = random.Random(11)
    pieces = [sentence(rng, n) for n in (5, 19, 20, 21, 40, 90)]
    rows = [(i, " ".join(rng.choices([*pieces, sentence(rng, 7)], k=rng.randrange(6)))) for i in range(60)]
    check_substrings(spark.createDataFrame(rows, "doc_id long, text string"))


def test_substring_empty_and_repeated_rows(spark):
    assert substring_dedup(empty(spark)).count() == 0
    text = sentence(random.Random(1), 30)
    twice = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup(twice).collect()] == [0, 0]


def grouped(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d))
    return {d: (min(g)[1], len(g), min(g)[1] == d, hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, d in g}


@pytest.mark.parametrize("incoming", ["doc_id % 2 = 1", "true", "false", "cast(null as boolean)"])
def test_exact_awkward(spark, incoming):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup(docs, F.expr(incoming), rows_per_bucket=4).collect()}
    assert got == grouped(rows)


def test_exact_empty(spark):
    assert exact_dedup(empty(spark), F.lit(True)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 50_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 60, n, dtype=np.uint64)
    data = build_fuse_filter(keys)
    assert probe_fuse_filter(data, keys).all()
    assert probe_fuse_filter(data, rng.integers(1 << 60, 1 << 61, 20_000, dtype=np.uint64)).mean() < 0.001


def linked(rows, n=5, threshold=0.8):
    sets = {}
    for d, t in rows:
        ws = WORD.findall(t or "")
        if ws:
            sets[d] = frozenset(tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1)))
    near = {d: {e for e in sets if e != d and len(sets[d] & sets[e]) >= threshold * len(sets[d] | sets[e])} for d in sets}
    out = {}
    for d, _ in rows:
        seen, todo = {d}, [d]
        while todo:
            for e in near.get(todo.pop(), ()):
                if e not in seen:
                    seen.add(e)
                    todo.append(e)
        out[d] = (min([e for e in sets if sets[e] == sets.get(d)], default=d), min(seen), len(near.get(d, ())))
    return out


def check_links(docs, **options):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["rep_id"], r["class_id"], r["n_links"]) for r in jaccard_join(docs, **options).collect()}
    assert got == linked(rows)


def test_join_awkward(spark):
    check_links(awkward(spark))


@pytest.mark.parametrize("block", [512, 4])
def test_join_families(spark, block):
    """Near copies in families of many, also when buckets and components are dealt out in small blocks."""
    rng = random.Random(5)
    rows = []
    for family in range(4):
        words = sentence(rng, 80).split()
        for _ in range(12):
            mine = list(words)
            for _ in range(rng.randrange(3)):
                mine[rng.randrange(len(mine))] = f"edit{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(mine)))
    rows += [(len(rows) + i, rows[i][1]) for i in range(5)]
    check_links(spark.createDataFrame(rows, "doc_id long, text string"), block=block)


def test_join_empty(spark):
    assert jaccard_join(empty(spark)).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    bounds = dict(least_matches(0.8, 1e-6))
    assert bounds[112] < 0.75 * 112
    rng = np.random.default_rng(0)
    a = rng.integers(0, 60000, 112, dtype=np.uint16)
    close, far = a.copy(), rng.integers(0, 60000, 112, dtype=np.uint16)
    close[::6] = 65000
    pairs = surviving_pairs(np.stack([a, close, far]), 0.8, 1e-6)
    assert list(zip(*map(list, pairs))) == [(0, 1)]


def test_shared_counts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 50, 30)).astype(np.uint64) for _ in range(6)]
    got = shared_counts(sets, np.arange(6), np.arange(6), width=7)
    off = ~np.eye(6, dtype=bool)
    assert (got[off] == np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])[off]).all()


@pytest.mark.parametrize("n", [400, 10_000])
def test_components_of_shuffled_chains(spark, monkeypatch, n):
    ids = list(range(n))
    random.Random(n).shuffle(ids)
    tables = []
    monkeypatch.setattr(components, "written", lambda df, name: tables.append(name) or written(df, name))
    got = connected_components(spark.createDataFrame(list(zip(ids, ids[1:])), "src long, dst long")).collect()
    assert len(got) == n and {r["component"] for r in got} == {0} and tables.count("named") < 20


def test_components_of_all_shapes(spark):
    rng = random.Random(12)
    star = [(9000, i) for i in range(8000, 8400)]
    edges = star + [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1700)] + [(4000 + i, 4000 + (i + 1) % 50) for i in range(50)] * 2
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()} == {x: root(x) for x in linked}


def test_join_of_a_shuffled_chain(spark):
    """Eight hundred revisions, each near the next alone, with ids in no order."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(8 * 800 + 90)]
    texts, ids = [" ".join(words[8 * i : 8 * i + 90]) for i in range(800)], list(range(800))
    rng.shuffle(ids)
    got = jaccard_join(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()
    by_place = sorted(got, key=lambda r: ids.index(r["doc_id"]))
    assert {r["class_id"] for r in got} == {0} and [r["n_links"] for r in by_place] == [1] + [2] * 798 + [1]


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(chain).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}


def test_repeats_are_maximal_and_stand_earlier(spark):
    """The repeats cover what is removed, do not touch, and each of their windows starts somewhere earlier."""
    rng = random.Random(17)
    pieces = [sentence(rng, n) for n in (25, 40, 90)]
    rows = {i: " ".join(rng.choices([*pieces, sentence(rng, 9)], k=rng.randrange(1, 6))).split() for i in range(50)}
    out = substring_dedup(spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")).collect()
    assert any(len(r["repeats"]) > 1 for r in out)
    first = {}
    for d in sorted(rows):
        for s in range(len(rows[d]) - 19):
            first.setdefault(tuple(rows[d][s : s + 20]), (d, s))
    for r in out:
        mine, covered, end = rows[r["doc_id"]], set(), -1
        for a, n in r["repeats"]:
            assert n >= 20 and a > end
            end = a + n
            covered.update(range(a, end))
            for edge in (a, end - 20):
                assert first[tuple(mine[edge : edge + 20])] < (r["doc_id"], edge)
        assert len(covered) == r["n_removed"]


@pytest.mark.parametrize("block_bytes", [4 << 20, 2000])
def test_join_of_a_long_chain(spark, block_bytes):
    """Neighbours are linked, ends are not: what pruning drops must not cost a link, whatever the blocks."""
    rng = random.Random(23)
    words = sentence(rng, 400).split()
    rows = [(i, " ".join(words[4 * i : 4 * i + 90])) for i in range(70)]
    check_links(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=block_bytes)


def test_recall_by_similarity(spark):
    """Pairs of every similarity from 0.8 up are linked, those below are not."""
    rng = random.Random(31)
    rows = []
    for i in range(150):
        words = sentence(rng, 120).split()
        near = list(words)
        for at in range(rng.randrange(8)):
            near[10 + 14 * at] = f"edit{rng.randrange(10**6)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near))]
    check_links(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("most_sent", [100_000, 0])
def test_substrings_of_ids_with_several_texts(spark, monkeypatch, most_sent):
    """No row is lost: a copy of an earlier text under an id that names a short text too, and long texts under one id."""
    from lectern.llm import substring_dedup as op

    monkeypatch.setattr(op, "MOST_SENT", most_sent)
    rng = random.Random(14)
    a, b, c = (sentence(rng, 30) for _ in range(3))
    rows = [(3, a), (5, a), (5, "a short one"), (7, b), (7, c), (7, c), (9, b + " and " + c), (8, None), (8, "")]
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(d for d, *_ in got) == sorted(d for d, _ in rows)
    by_id = defaultdict(list)
    for d, n, gone, kept in got:
        by_id[d].append((n, gone, kept))
    assert by_id[3] == [(30, 0, a)] and sorted(by_id[5]) == [(3, 0, "a short one"), (30, 30, "")] and by_id[8] == [(0, 0, "")] * 2
    # one of the two texts of 7 stands before 9, the other after it
    assert sum(n for n, *_ in by_id[7]) == 90 and by_id[9][0][0] == 61
    kept = [k for _, _, k in by_id[7]] + [by_id[9][0][2]]
    assert (b in by_id[9][0][2]) != (c in by_id[9][0][2]) and all(any(x in k for k in kept) for x in (b, c))
