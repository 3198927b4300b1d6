"""Reading the tables, the reference model on top of them, and the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its zone-free timestamps as instants of the session's zone (UTC), which windows and watermarks need."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    casts = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns(casts) if casts else df


def scoped(df: DataFrame, **equal) -> DataFrame:
    """Scan with the equality predicates that are given; a list or tuple asks for membership, None and empty lists for nothing."""
    for name, value in equal.items():
        if value is None or (isinstance(value, (list, tuple, set)) and not value):
            continue
        df = df.where(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return df


def owned(df: DataFrame, key: str, value, owner: str, user) -> DataFrame:
    """Point lookup that also checks the owner."""
    return df.where((F.col(key) == value) & (F.col(owner) == user)).limit(1)


def binary_documents(spark: SparkSession, path: str, magic: bytes = b"%PDF-") -> DataFrame:
    """Files of a folder with size and whether they begin with the magic bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", "modificationTime", "content", (F.substring("content", 1, len(magic)) == F.lit(magic)).alias("has_magic"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_documents(df: DataFrame, path: str, key: str) -> None:
    """Replace the partitions of the documents at hand and leave all others (delete stale rows, insert new ones)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def bounded_json_array(df: DataFrame, order: list[Column]) -> DataFrame:
    """One row with a JSON array of all rows in order: for results whose size is bounded by a limit, such as one page."""
    rows = df.select(F.struct(*order).alias("__order"), F.struct(*df.columns).alias("__row"))
    return rows.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("__order", "__row"))), lambda x: x["__row"])).alias("json"))
