"""Query of operator 9; held-out accuracy is tested."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .toxicity import score_toxicity


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    out = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=fold != 0)
    return out.select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")
