"""Query of operator 3; tested against a brute-force scheduler."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .mixing import mix_sources


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), block=32)
