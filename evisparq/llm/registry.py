"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_corpus, queries_dedup, queries_layout, queries_text, queries_tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": queries_tokens.op1_token_counts,
        "op2_packing": queries_layout.op2_packing,
        "op3_sharding": queries_layout.op3_sharding,
        "op4_token_files": queries_layout.op4_token_files,
        "op5_exact_dedup": queries_dedup.op5_exact_dedup,
        "op6_ngram_join": queries_dedup.op6_ngram_join,
        "op7_suffix_dedup": queries_dedup.op7_suffix_dedup,
        "op8_mixing": queries_layout.op8_mixing,
        "op9_html_text": queries_text.op9_html_text,
        "op10_quality": queries_text.op10_quality,
        "op11_merkle": queries_corpus.op11_merkle,
        "op12_resampling": queries_corpus.op12_resampling,
        "op13_debruijn": queries_corpus.op13_debruijn,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_exact_dedup": queries_dedup.OP5_SQL,
        "op6_ngram_join": queries_dedup.OP6_SQL,
        "op7_suffix_dedup": queries_dedup.OP7_SQL,
        "op9_html_text": queries_text.OP9_SQL,
        "op11_merkle": queries_corpus.OP11_SQL,
        "op12_resampling": queries_corpus.OP12_SQL,
        "op13_debruijn": queries_corpus.OP13_SQL,
    }
