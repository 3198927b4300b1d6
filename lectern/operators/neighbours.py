"""Nearest neighbours over an inverted file: trained coarse cells, many questions at once, approximate or exact.

Rows lie in folders by the cell of their vector's direction, large cells in parts.  A question reads the cells whose centres
are nearest; questions and cell parts meet by cell, and each part answers all its questions by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STORED = "id long, unit array<double>, part int, cell int"
FOUND = "query_id long, id long, score double, cell int"
ASKED_AT_ONCE = 5_000  # questions, on average, that meet a part of a cell at once


ROWS_AT_ONCE = 256  # vectors that are compared with all centres at once
PAIRS_AT_ONCE = 4096  # questions with a cell that leave a task at once


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of few rows, as a row takes a number for each cell."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def unit_rows(lists: pa.Array) -> np.ndarray:
    """Vectors of unit length; a zero vector stays zero."""
    x = np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def train_centres(units: np.ndarray, cells: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Centres of unit length by k-means on directions; a cell that runs empty starts again at the worst served row."""
    centres = units[np.random.default_rng(seed).permutation(len(units))[:cells]]
    for _ in range(rounds):
        near = units @ centres.T
        own, best = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[empty] = units[np.argsort(best)[: len(empty)]]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
    return centres


def _placed(centres: np.ndarray):
    schema = pa.schema([("id", pa.int64()), ("unit", pa.list_(pa.float64())), ("cell", pa.int32()), ("angle", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            units = unit_rows(batch.column(1))
            near = units @ centres.T
            own = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(own)), own], -1, 1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * units.shape[1], pa.int32()), pa.array(units.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(own, pa.int32()), pa.array(angle)], schema=schema)

    return run


def _answered(k: int):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        names, kinds = ["query_id", "id", "score", "cell"], [pa.int64(), pa.int64(), pa.float64(), pa.int32()]
        if not rows.num_rows or not asked.num_rows:
            return pa.Table.from_arrays([pa.array([], kind) for kind in kinds], names=names)
        units, questions = unit_rows(rows["unit"].combine_chunks()), unit_rows(asked["unit"].combine_chunks())
        ids, query_ids = rows["id"].to_numpy(), asked["query_id"].to_numpy()
        out = []
        for at in range(0, len(questions), 256):
            score = np.round(questions[at : at + 256] @ units.T, 6)
            for q, line in zip(query_ids[at : at + 256], score, strict=True):
                least = np.partition(line, -k)[-k] if k < len(line) else -2.0
                near = np.flatnonzero(line >= least)
                near = near[np.lexsort((ids[near], -line[near]))[:k]]
                out.append((np.full(len(near), q), ids[near], line[near]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        columns.append(np.full(len(columns[0]), rows["cell"][0].as_py()))
        return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)

    return run


class CellIndex:
    """A stored inverted file.

    Centres are trained on at most ``sample`` rows; every row is indexed.  Rows without a vector, or whose vector is zero, are in
    no cell, as no cosine exists for them.  ``cells`` defaults to about the square root of the rows, at most 4096.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def build(self, rows: DataFrame, *, key: str = "id", vector: str = "embedding", cells: int | None = None, sample: int = 20_000, part_rows: int = 50_000, seed: int = 0) -> CellIndex:
        known = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("unit")).where(F.col("unit").isNotNull() & F.exists("unit", lambda x: x != 0))
        n = known.count()
        draw = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / float(1 << 30)
        taken = known.where(draw <= 2.0 * sample / max(1, n)).orderBy(F.xxhash64(F.lit(seed), "id")).limit(sample).select("unit").toArrow()
        units = unit_rows(taken["unit"].combine_chunks()) if n else np.zeros((1, 1))
        self.centres = train_centres(units, cells or min(4096, max(1, int(sqrt(n)))), seed=seed)
        placed = known.mapInArrow(_placed(self.centres), "id long, unit array<double>, cell int, angle double")
        placed.write.mode("overwrite").parquet(f"{self.folder}/placed")
        placed = self.spark.read.schema("id long, unit array<double>, cell int, angle double").parquet(f"{self.folder}/placed")
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("reach")).collect()  # one row a cell
        self.parts, self.reach = np.ones(len(self.centres), np.int64), np.full(len(self.centres), -1.0)  # -1: nothing there
        for r in sizes:
            self.parts[r["cell"]], self.reach[r["cell"]] = ceil(r["n"] / part_rows), r["reach"]
        many = F.element_at(F.array(*(F.lit(int(x)) for x in self.parts)), F.col("cell") + 1)
        parted = placed.withColumn("part", F.pmod(F.xxhash64("id"), many).cast("int")).select("id", "unit", "part", "cell")
        parted.repartition("cell", "part").write.mode("overwrite").partitionBy("cell").parquet(f"{self.folder}/cells")
        return self

    def _meet(self, asked: DataFrame, k: int) -> DataFrame:
        """The best k of each question among the cells it names: (query_id, id, score)."""
        # a cell asked by very many questions answers them in turns, as a turn's rows and questions are in memory together
        turns = [0] * len(self.parts)
        for r in asked.groupBy("cell").count().collect():  # one row a cell
            turns[r["cell"]] = ceil(r["count"] / ASKED_AT_ONCE)
        cells = [cell for cell, n in enumerate(turns) if n]
        stored = self.spark.read.schema(STORED).parquet(f"{self.folder}/cells").where(F.col("cell").isin(cells))
        last = F.element_at(F.array(*(F.lit(int(x) - 1) for x in self.parts)), F.col("cell") + 1)
        of_cell = F.element_at(F.array(*(F.lit(x) for x in turns)), F.col("cell") + 1)
        per_part = asked.withColumn("part", F.explode(F.sequence(F.lit(0), last))).withColumn("turn", F.pmod(F.xxhash64("query_id"), of_cell).cast("int"))
        stored = stored.withColumn("turn", F.explode(F.sequence(F.lit(0), of_cell - 1)))
        found = stored.groupBy("cell", "part", "turn").cogroup(per_part.groupBy("cell", "part", "turn")).applyInArrow(_answered(k), FOUND)
        return self._best(found, k)

    @staticmethod
    def _best(found: DataFrame, k: int) -> DataFrame:
        first = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)

    def _cells_of(self, questions: DataFrame, choose) -> DataFrame:
        """(query_id, unit, cell) of the cells that ``choose`` picks from (question units, other columns of the batch)."""
        schema = pa.schema([("query_id", pa.int64()), ("unit", pa.list_(pa.float64())), ("cell", pa.int32())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                q, cell = np.nonzero(choose(unit_rows(batch.column("unit")), batch))
                for at in range(0, len(q), PAIRS_AT_ONCE):
                    some = pa.array(q[at : at + PAIRS_AT_ONCE])
                    yield pa.RecordBatch.from_arrays([batch.column("query_id").take(some), batch.column("unit").take(some), pa.array(cell[at : at + PAIRS_AT_ONCE], pa.int32())], schema=schema)

        return questions.mapInArrow(run, "query_id long, unit array<double>, cell int")

    def search(self, questions: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, id, score, cell, rank): the best k rows of each question (query_id, unit) by cosine, ties by id.

        With ``probes`` each question reads that many cells, those with the nearest centres.  Without, the answer is exact: the
        cells that may still hold a better row than the k-th found so far, by the angles of their centre and reach, are read too.
        """
        centres, reach = self.centres, self.reach
        if (reach < 0).all():
            return self.spark.createDataFrame([], f"{FOUND}, rank int")
        there, first = reach >= 0, min(probes or 4, len(centres))

        def nearest(units: np.ndarray, _) -> np.ndarray:
            near = np.where(there, units @ centres.T, -2.0)
            order = np.argsort(-near, axis=1, kind="stable")[:, :first]
            out = np.zeros(near.shape, bool)
            np.put_along_axis(out, order, True, axis=1)
            return out & there

        def hopeful(units: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
            bar = np.asarray(batch.column("bar"))
            angle = np.arccos(np.clip(units @ centres.T, -1, 1))
            best = np.cos(np.maximum(angle - reach, 0))
            return (best >= bar[:, None] - 1e-6) & there & ~nearest(units, batch)

        found = self._meet(self._cells_of(questions, nearest), k)
        if probes is not None:
            return found
        bars = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(-2.0).alias("bar"))
        more = self._cells_of(questions.join(bars, "query_id", "left").withColumn("bar", F.coalesce("bar", F.lit(-2.0))), hopeful)
        return self._best(found.drop("rank").unionByName(self._meet(more, k).drop("rank")), k)

    def probes_for(self, questions: DataFrame, k: int, least: float = 0.95) -> int:
        """The fewest probes that find a share of ``least`` of the exact best k of these questions.

        Each of the best rows is found by as many probes as there are cells whose centre is no farther than its own cell's.
        """
        centres, there = self.centres, self.reach >= 0

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                near = np.where(there, unit_rows(batch.column("unit")) @ centres.T, -2.0)
                order = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1, kind="stable")
                at = order[np.arange(len(order)), np.asarray(batch.column("cell"))]
                yield pa.RecordBatch.from_arrays([pa.array(at + 1, pa.int32())], names=["probes"])

        best = self.search(questions, k).select("query_id", "cell").join(questions, "query_id").select("unit", "cell")
        needed = sorted((r["probes"], r["count"]) for r in best.mapInArrow(place, "probes int").groupBy("probes").count().collect())
        total, found = sum(n for _, n in needed), 0
        for probes, n in needed:
            found += n
            if found >= least * total:
                return probes
        return 1
