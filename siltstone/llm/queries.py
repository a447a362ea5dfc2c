"""The queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import ann, bpe, chat, divergence, filter_audit, knn, packing, quality, simhash, substring_dedup, token_count, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_chat_format": chat.op2_chat_format,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_warc": warc.op4_warc,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_top_k": knn.op6_top_k,
        "op7_bpe": bpe.op7_bpe,
        "op8_token_counts": token_count.op8_token_counts,
        "op9_packing": packing.op9_packing,
        "op10_simhash": simhash.op10_simhash,
        "op11_source_divergence": divergence.op11_source_divergence,
        "op12_nearest": ann.op12_nearest,
        "op13_filter_audit": filter_audit.op13_filter_audit,
        "quality_by_half": quality.quality_by_half,
        "warc_revisits": warc.warc_revisits,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring_dedup.ORACLE_SQL,
        "op2_chat_format": chat.ORACLE_SQL,
        "op4_warc": warc.ORACLE_SQL,
        "op5_quality_rules": quality.ORACLE_SQL,
        "op6_top_k": knn.ORACLE_SQL,
        "op11_source_divergence": divergence.ORACLE_SQL,
        "op13_filter_audit": filter_audit.ORACLE_SQL,
        "quality_by_half": quality.BY_HALF_SQL,
        "warc_revisits": warc.REVISITS_SQL,
    }
