"""Registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from campanula.llm import (
    bestfit,
    chat,
    fill_in_middle,
    mixing,
    prefix_trie,
    quality,
    sanitize,
    secrets,
    simhash,
    substring,
    token_counts,
    token_output,
    topk,
)
from campanula.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _on(name: str, op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(table(spark, sf_dir, name))


QUERIES: dict[str, Query] = {
    "op1_chat_format": _on("conversations", chat.op1),
    "op2_secret_scan": _on("documents", secrets.op2),
    "op3_mix_sources": _on("documents", mixing.op3),
    "op4_substring_dedup": _on("documents", substring.op4),
    "op5_quality_rules": _on("documents", quality.op5),
    "op6_simhash_near_dedup": _on("documents", simhash.op6),
    "op7_exact_top_k": _on("embeddings", topk.op7),
    "op8_token_matrices": _on("documents", token_output.op8),
    "op9_sanitise": _on("documents", sanitize.op9),
    "op10_best_fit_packing": _on("documents", bestfit.op10),
    "op11_fill_in_middle": _on("documents", fill_in_middle.op11),
    "op12_prefix_trie": _on("conversations", prefix_trie.op12),
    "op13_token_counts": _on("documents", token_counts.op13),
}

ORACLE_SQL: dict[str, str] = {"op1_chat_format": chat.SQL}
