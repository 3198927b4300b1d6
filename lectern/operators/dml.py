"""Data changes as rewrites: plain Parquet has no MERGE, so each returns the table as it is afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("__k", F.row_number().over(newest)).where("__k = 1").drop("__k")


def upsert(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Insert, or replace where the key is there (changes have one row a key)."""
    return target.join(changes.select(*keys), keys, "left_anti").select(*target.columns).unionByName(changes)


def insert_missing(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Insert where the key is not there."""
    return target.unionByName(rows.join(target.select(*keys), keys, "left_anti").select(*target.columns))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def set_null_on_delete(child: DataFrame, foreign: str, gone: DataFrame, key: str) -> DataFrame:
    marks = gone.select(F.col(key).alias(foreign), F.lit(True).alias("__gone"))
    return child.join(marks, foreign, "left").withColumn(foreign, F.when(F.col("__gone").isNull(), F.col(foreign))).select(*child.columns)


def update_fields(rows: DataFrame, changes: dict, edited: str | None = None) -> DataFrame:
    """Set the fields that are given; those named in the row's ``edited`` array stay as the user left them."""
    out = {}
    for name, value in changes.items():
        new = F.lit(value)
        out[name] = F.when(F.array_contains(F.coalesce(edited, F.array().cast("array<string>")), name), F.col(name)).otherwise(new) if edited else new
    return rows.withColumns(out)


def check_violations(rows: DataFrame, **allowed) -> DataFrame:
    """Rows whose column holds a value that its CHECK does not list."""
    bad = F.lit(False)
    for name, values in allowed.items():
        bad = bad | ~F.coalesce(F.col(name).isin(*values), F.lit(False))
    return rows.where(bad)


def backfill(rows: DataFrame, column: str, *sources: str) -> DataFrame:
    """Fill a column's nulls from the first of the sources that has a value; what it has stays."""
    return rows.withColumn(column, F.coalesce(column, *sources))
