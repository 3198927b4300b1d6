"""Vector expressions: dot product, norm, cosine similarity, element-wise mean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine distance; null where a side is null or has norm zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Element-wise mean of the vectors of each key: (key, mean_vector).  Only sums travel, one row per key and place."""
    cells = rows.where(F.col(vector).isNotNull()).select(key, F.posexplode(vector).alias("place", "value"))
    means = cells.groupBy(key, "place").agg(F.avg(F.col("value").cast("double")).alias("value"))
    ordered = means.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("cells"))
    return ordered.select(key, F.transform("cells", lambda c: c["value"]).alias("mean_vector"))
