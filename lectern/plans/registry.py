"""All queries of the library with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import documents, library, pages, reading, retrieval, state, text, training, workflows

Query = Callable[[SparkSession, str], DataFrame]
PARTS = (retrieval, library, state, text, training, documents, reading, workflows, pages)


def queries() -> dict[str, Query]:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
