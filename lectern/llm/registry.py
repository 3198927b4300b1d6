"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_op1, q_op2, q_op3, q_op4, q_op5, q_op6, q_op7, q_op8, q_op9, q_op10, q_op11, q_op12, q_op13

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_substring_dedup": q_op1.op1_substring_dedup,
        "op2_language_id": q_op2.op2_language_id,
        "op3_source_mixing": q_op3.op3_source_mixing,
        "op4_jaccard_join": q_op4.op4_jaccard_join,
        "op5_license_scan": q_op5.op5_license_scan,
        "op6_exact_dedup": q_op6.op6_exact_dedup,
        "op7_chat_formatting": q_op7.op7_chat_formatting,
        "op8_pii": q_op8.op8_pii,
        "op9_toxicity": q_op9.op9_toxicity,
        "op10_decontamination": q_op10.op10_decontamination,
        "op11_hard_negatives": q_op11.op11_hard_negatives,
        "op12_source_divergence": q_op12.op12_source_divergence,
        "op13_lm_score": q_op13.op13_lm_score,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": q_op1.SQL,
        "op4_jaccard_join": q_op4.SQL,
        "op5_license_scan": q_op5.SQL,
        "op6_exact_dedup": q_op6.SQL,
        "op7_chat_formatting": q_op7.SQL,
        "op11_hard_negatives": q_op11.SQL,
        "op12_source_divergence": q_op12.SQL,
    }
