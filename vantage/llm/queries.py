"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES = {
    "op1_ngram_jaccard_join": "ngram_join",
    "op2_token_store": "token_store",
    "op3_chat_rotation": "chat",
    "op4_secret_scan": "secret_scan",
    "op5_vector_search": "vector_search",
    "op6_toxicity": "toxicity",
    "op7_bpe": "bpe",
    "op8_packing": "packing",
    "op9_substring_dedup": "substring_dedup",
    "op10_exact_dedup": "exact_dedup",
    "op11_centroid_clusters": "centroids",
    "op12_token_alignment": "alignment",
    "op13_language_id": "language_id",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(f"vantage.llm.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"vantage.llm.{module}"), "ORACLE", None) for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
