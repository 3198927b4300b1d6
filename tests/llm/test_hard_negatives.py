"""Hard negatives against a plain search over all pairs, and the certain intervals against exact products."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from lectern.llm.hard_negatives import Anchors, Rows, coded, mine_hard_negatives, rotation
from pyspark.sql import functions as F

DDL = "vec_id long, embedding array<float>, label int, score long, key long, row string, slot int"


def plain(rows, per=5, most=5, low=80):
    """(anchor, positive, rank, negative, scores) by looking at every pair."""
    ok = [(v, [math.floor(256 * x) for x in e], y) for v, e, y in rows if e is not None and y is not None and all(x is not None and math.isfinite(x) for x in e)]
    place = lambda v: (v is not None, v or 0)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, (v, e, y) in enumerate(ok):
        if v is None or v % 100:
            continue
        near = sorted((-dot(e, f), place(w), w) for j, (w, f, z) in enumerate(ok) if j != i and z == y)[:per]
        other = sorted((-dot(e, f), place(w), w) for w, f, z in ok if z != y)
        for s, _, w in near:
            fit = [(t, u) for t, _, u in other if low * -s <= 100 * -t <= 100 * -s][:most]
            out += [(v, w, k, u, -s, -t) for k, (t, u) in enumerate(fit, 1)]
    return sorted(map(repr, out))


def found(spark, rows, **options):
    df = spark.createDataFrame([(v, e, y, 1, 2, "r", 3) for v, e, y in rows], DDL).repartition(3)
    out = mine_hard_negatives(df, anchor=F.col("vec_id") % 100 == 0, label=F.col("label"), **options).collect()
    return sorted(repr(tuple(r)) for r in out)


def vectors(rng, n, size=64, ids=None, labels=4):
    centre = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(6)]
    near = lambda: [x + rng.gauss(0, 0.7) for x in rng.choice(centre)]
    unit = lambda v: [float(np.float32(x / math.sqrt(sum(y * y for y in v)))) for x in v]
    return [(ids[i] if ids else i * 10, unit(near()), rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("size", [3, 64, 100])
def test_every_pair(spark, size):
    rows = vectors(random.Random(size), 300, size)
    assert len(plain(rows)) > 300 and found(spark, rows) == plain(rows)


def test_many_blocks(spark):
    rows = vectors(random.Random(4), 400, 16, ids=[100 * i if i % 3 else i for i in range(400)])
    assert found(spark, rows, block_bytes=20_000) == plain(rows)


def test_awkward_rows(spark):
    rng = random.Random(9)
    rows = vectors(rng, 60, 8, labels=2)
    nan, inf = float("nan"), float("inf")
    rows += [(None, rows[0][1], 1), (None, rows[0][1], 0), (100, None, 1), (200, rows[3][1], None), (300, [nan] + rows[3][1][1:], 1), (400, [inf] + [0.0] * 7, 0), (500, [None] + [0.1] * 7, 1)]
    rows += [rows[0]] * 3 + [rows[1]] * 4 + [(600, [0.0] * 8, 0), (700, [], 1), (7, [1.0, -1.0], 0), (800, [-0.001] * 8, 1), (900, [-x for x in rows[0][1]], 0)]
    assert found(spark, rows) == plain(rows)


def test_one_hot_label_and_equal_vectors(spark):
    rng = random.Random(2)
    rows = vectors(rng, 200, 16, labels=1) + [(3000 + i, [0.25] * 16, i % 2) for i in range(150)]
    assert found(spark, rows) == plain(rows)


def test_nothing_to_do(spark):
    assert found(spark, []) == [] and found(spark, [(100, None, 1)]) == [] and found(spark, [(1, [0.5], 1), (2, [0.5], 2)]) == []
    with pytest.raises(Exception, match="too large"):
        found(spark, [(100, [1e9], 1)])


def test_intervals_hold_and_tighten():
    rng = np.random.default_rng(5)
    x, q = (np.floor(40 * rng.standard_normal((n, 64))).astype(np.int64) for n in (200, 50))
    turn = rotation(64, 1)
    codes, align, held, rest = coded(x, turn, 4)
    assert np.allclose(turn @ turn.T, np.eye(64)) and (np.diff(rest, axis=1) < 0).all() and rest[:, 3].mean() < 0.2 * np.linalg.norm(x, axis=1).mean()
    listed = lambda v: pa.array(list(v.reshape(len(v), -1)))

    def rows(v):
        c, *more = coded(v, turn, 4)
        whole = np.arange(len(v))
        return Rows(pa.RecordBatch.from_arrays([pa.array(whole)] * 3 + [listed(v), listed(c.view(np.int64)), *map(listed, more)], names=["row", "key", "label", "whole", "codes", "align", "held", "rest"]), 4)

    anchors, exact, all_rows = Anchors(rows(q), turn), x @ q.T, rows(x)
    for cut in np.quantile(exact, [0.5, 0.9, 0.99]):
        ri, ai = anchors.surviving(all_rows, np.arange(200), np.arange(50), np.full(50, cut), np.full(50, np.inf))
        kept = np.zeros(exact.shape, bool)
        kept[ri, ai] = True
        assert kept[exact >= cut].all()
    assert kept.mean() < 0.25  # a hundredth is wanted, of vectors without any structure
