"""Queries of the numbered operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["op1_sentencepiece_dropout", "op2_quality_rules", "op3_neural_lm", "op4_chat", "op5_token_files", "op6_weak_quality", "op7_near_duplicates", "op8_language_id", "op9_toxicity", "op10_decontamination", "op11_periodic_runs", "op12_byte_bpe", "op13_alignment"]


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Queries by name, and the SQL of those that SQL can express."""
    modules = {name: import_module(f"{__name__}.{name}") for name in MODULES}
    return {n: m.query for n, m in modules.items()}, {n: m.SQL for n, m in modules.items() if getattr(m, "SQL", None)}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
