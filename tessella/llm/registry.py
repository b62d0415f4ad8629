"""Queries and SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tessella.llm import chat, chunked_bpe, exact_dedup, packing, quality, secrets, simhash, substring_dedup, token_counts, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        substring_dedup.op1_substring_dedup,
        secrets.op2_secret_scans,
        chunked_bpe.op3_bpe_round_trip,
        chat.op4_chat_formatting,
        chat.chat_tool_calls,
        exact_dedup.op5_exact_dedup,
        token_counts.op6_token_counts,
        packing.op7_packing,
        quality.op8_quality_rules,
        simhash.op9_simhash_near_dedup,
        toxicity.op10_toxicity,
    )
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    sql = {
        "op4_chat_formatting": chat.OP4_SQL,
        "chat_tool_calls": chat.CALLS_SQL,
        "op5_exact_dedup": exact_dedup.OP5_SQL,
        "op8_quality_rules": quality.OP8_SQL,
        "pipeline": corpus_pipeline.ORACLE_SQL,
    }
    return {k: v for k, v in sql.items() if v is not None}
