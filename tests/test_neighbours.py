"""The inverted file against all pairs: exact search, measured recall, hot cells in parts."""

import numpy as np
from lectern.operators.neighbours import CellIndex, train_centres
from pyspark.sql import functions as F


def clustered(n, size, centres, seed, spread=0.25):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, size))
    return c[rng.integers(0, centres, n)] + spread * rng.standard_normal((n, size))


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v) for i, v in enumerate(x.tolist())], "id long, embedding array<double>")


def best(x, q, k):
    s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    return [[int(i) for i in np.lexsort((np.arange(len(x)), -np.round(line, 6)))[:k]] for line in s]


def asked(spark, q):
    return frame(spark, q).select(F.col("id").alias("query_id"), F.col("embedding").alias("unit"))


def listed(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def test_exact_and_recall(spark, tmp_path):
    x, q = clustered(3000, 16, 40, 1), clustered(30, 16, 40, 1)
    index = CellIndex(spark, str(tmp_path / "i")).build(frame(spark, x), cells=50, part_rows=40)
    want = best(x, q, 10)
    assert index.parts.max() > 1 and listed(index.search(asked(spark, q), 10)) == dict(enumerate(want))
    probes = index.probes_for(asked(spark, q[:15]), 10)
    got = listed(index.search(asked(spark, q[15:]), 10, probes))
    recall = np.mean([len(set(got[i]) & set(best(x, q[15:], 10)[i])) / 10 for i in range(15)])
    assert probes <= 8 and recall >= 0.95


def test_hard_cases(spark, tmp_path):
    x = np.vstack([np.tile([1.0, 0, 0, 0], (200, 1)), np.eye(4), -np.eye(4)])
    rows = frame(spark, x).unionByName(spark.createDataFrame([(900, None), (901, [0.0] * 4)], "id long, embedding array<double>"))
    index = CellIndex(spark, str(tmp_path / "i")).build(rows, cells=6, part_rows=50)
    q = np.array([[1.0, 0, 0, 0], [0, -1.0, 0.1, 0]])
    assert listed(index.search(asked(spark, q), 7)) == dict(enumerate(best(x, q, 7)))
    assert len(listed(index.search(asked(spark, q), 300))[0]) == 208
    none = CellIndex(spark, str(tmp_path / "none")).build(rows.limit(0))
    assert none.search(asked(spark, q), 3).count() == 0


def test_centres_are_kept_apart():
    units = clustered(500, 8, 5, 3)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    centres = train_centres(units, 5)
    assert np.allclose(np.linalg.norm(centres, axis=1), 1) and (units @ centres.T).max(axis=1).mean() > 0.8


def test_many_questions_meet_a_cell_in_turns(spark, tmp_path, monkeypatch):
    """What a task holds of the questions of a cell has a limit; the answer is the same."""
    from lectern.operators import neighbours

    x, q = clustered(400, 8, 5, 6), clustered(90, 8, 5, 7)
    index = CellIndex(spark, str(tmp_path / "i")).build(frame(spark, x), cells=4, part_rows=60)
    monkeypatch.setattr(neighbours, "ASKED_AT_ONCE", 20)
    seen, answered = tmp_path / "seen", neighbours._answered
    seen.mkdir()

    def counted(k):
        run, folder = answered(k), str(seen)

        def counting(rows, asked):
            import uuid
            from pathlib import Path

            Path(folder, f"{asked.num_rows}-{uuid.uuid4().hex}").touch()
            return run(rows, asked)

        return counting

    monkeypatch.setattr(neighbours, "_answered", counted)
    assert listed(index.search(asked(spark, q), 10)) == dict(enumerate(best(x, q, 10)))
    assert 0 < max(int(f.name.split("-")[0]) for f in seen.iterdir()) <= 45


def test_questions_leave_in_small_pieces(spark, tmp_path):
    """A batch of questions with all their cells is never in memory at once."""
    import pyarrow as pa
    from lectern.operators import neighbours

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([[1.0, float(i)] for i in range(1000)])], names=["query_id", "unit"])
    assert [b.num_rows for b in neighbours.pieces(iter([batch, batch.slice(0, 0)]))] == [256, 256, 256, 232]
    index = CellIndex(spark, str(tmp_path / "i")).build(frame(spark, clustered(200, 4, 3, 1)), cells=40)

    class Questions:
        def mapInArrow(self, run, schema):
            return [b.num_rows for b in run(iter([batch]))]

    sizes = index._cells_of(Questions(), lambda units, _: np.ones((len(units), 40), bool))
    assert sum(sizes) == 40_000 and max(sizes) <= neighbours.PAIRS_AT_ONCE
