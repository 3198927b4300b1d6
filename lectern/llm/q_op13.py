"""Query of operator 13; the automaton is tested against a plain model, the base against SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .lm_score import score_texts


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7
    return score_texts(table(spark, sf_dir, "documents"), held_out=fold == 2, order=2)
