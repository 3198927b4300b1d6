"""Query of operator 10; tested against a brute-force search."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontaminate import find_contamination


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
