"""Query of operator 2; held-out accuracy is tested."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .language_id import identify_language


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4
    out = identify_language(table(spark, sf_dir, "documents"), labelled=fold != 2, per_language=500, landmarks=256)
    return out.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")
