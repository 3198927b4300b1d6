"""Helpers that the operators share: tables, keys of rows, empty-safe Arrow output."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard, new_folder, written

__all__ = ["NO_ID", "arrow_batch", "column", "discard", "doc_key", "new_folder", "only", "sample_by_class", "shown_id", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NO_ID = -(1 << 62)


def doc_key() -> Column:
    """doc_id, and for rows without one a number under all others (ids are above -2**62), the same for equal texts."""
    return F.coalesce("doc_id", F.lit(NO_ID) - F.pmod(F.xxhash64("text"), F.lit(1 << 61)))


def shown_id(key: Column) -> Column:
    """The doc_id that a key stands for: null where there was none."""
    return F.when(key > NO_ID, key)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns cannot clash with those an operator adds."""
    return df.select(*(F.col(f"`{c}`") for c in columns))


def arrow_batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    arrays = []
    for field, values in zip(schema, columns, strict=True):
        if isinstance(values, pa.Array):
            arrays.append(values.cast(field.type))
        elif isinstance(values, np.ndarray) and values.dtype == np.uint64 and pa.types.is_int64(field.type):
            arrays.append(pa.array(values.view(np.int64), type=field.type))
        else:
            arrays.append(pa.array(values, type=field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def sample_by_class(rows: DataFrame, label: str, per_class: int) -> DataFrame:
    """Up to ``per_class`` rows of each class, the smallest by a hash of doc_id; classes with fewer keep all.

    Counts come first (a narrow scan), so that the rows which reach the ranking are about twice what is kept, whatever
    the table's size and however much of it one class holds.
    """
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    if counts.count() <= 10_000:
        counts = F.broadcast(counts)  # so that rows are thinned where they are read; with more classes they are dealt out
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    thinned = rows.join(counts, label).where(draw * F.col("__n") <= 2.0 * per_class + 50)
    best = Window.partitionBy(label).orderBy(F.xxhash64("doc_id"), *sorted(rows.columns))
    return thinned.withColumn("__k", F.row_number().over(best)).where(F.col("__k") <= per_class).select(*rows.columns)
