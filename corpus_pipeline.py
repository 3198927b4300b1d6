"""A training corpus in five stages: toxicity, exact dedup, near-duplicate join, benchmark decontamination, source mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.  All but the last return the columns
of documents; the last returns the order of the mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import doc_key, table, written
from lectern.llm.decontaminate import decontaminate
from lectern.llm.exact_dedup import exact_dedup
from lectern.llm.jaccard_join import jaccard_join
from lectern.llm.mixing import mix_sources
from lectern.llm.toxicity import score_toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a key for every row in place of doc_id (see ``doc_key``), beside their own columns."""
    return docs.select(doc_key().alias("__key"), "*")


def _asked(named: DataFrame) -> DataFrame:
    return named.select(F.col("__key").alias("doc_id"), "text")


def _only_keys(named: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``named`` whose key is (or is not) among the doc_ids of ``keys``, with the columns of the documents."""
    return named.join(keys.select(F.col("doc_id").alias("__key")).distinct(), "__key", how).select(*(F.col(f"`{c}`") for c in named.columns if c != "__key"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = _keyed(docs)
    scores = score_toxicity(_asked(named), table(spark, sf_dir, "labels"), learn=F.lit(True))
    return _only_keys(named, scores.where("predicted = 1"), "left_anti")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = _keyed(docs)
    incoming = F.crc32(F.col("doc_id").cast("string")) % 2 == 1
    return _only_keys(named, exact_dedup(_asked(named), incoming, keyed=True).where("kept"), "left_semi")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = _keyed(docs)
    return _only_keys(named, jaccard_join(_asked(named), n=5, threshold=0.8, keyed=True).where("doc_id = class_id"), "left_semi")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs, block=32)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]

#: Learnt scores and latent search have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
