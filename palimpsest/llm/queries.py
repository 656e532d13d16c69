"""The queries that the driver runs, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, line_dedup, lm_scoring, mixing, near_dedup, quality, token_files, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": token_files.query,
        "op2_line_dedup": line_dedup.query,
        "op3_mixing": mixing.query,
        "op4_quality": quality.query,
        "op5_toxicity": toxicity.query,
        "op6_lm_scoring": lm_scoring.query,
        "op7_chat": chat.query,
        "op8_near_dedup": near_dedup.query,
        "op9_bpe": bpe.query,
        "op10_ann": ann.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": line_dedup.SQL,
        "op4_quality": quality.SQL,
        "op7_chat": chat.SQL,
        "op8_near_dedup": near_dedup.SQL,
        "op10_ann": ann.SQL,
    }
