"""Queries of this subpackage and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidequery.llm import decontam, langid, line_dedup, mixing, paragraph_dedup, simhash, token_counts, tool_calls, url_filters, weighted_sampling


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_tool_call_linking": tool_calls.op1,
        "op2_line_dedup": line_dedup.op2,
        "op3_url_filters": url_filters.op3,
        "op4_token_counts": token_counts.op4,
        "op5_benchmark_decontamination": decontam.op5,
        "op6_substring_dedup": paragraph_dedup.op6,
        "op7_mixing": mixing.op7,
        "op8_weighted_fingerprints": weighted_sampling.op8,
        "op9_language_id": langid.op9,
        "op10_simhash_near_dedup": simhash.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": line_dedup.OP2_SQL,
        "op3_url_filters": url_filters.OP3_SQL,
        "op5_benchmark_decontamination": decontam.OP5_SQL,
    }
