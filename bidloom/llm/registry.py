"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

NAMES = {
    "op1_pii": "pii",
    "op2_token_store": "token_store",
    "op3_warc": "warc",
    "op4_nearest": "nearest",
    "op5_language": "language",
    "op6_mixing": "mixing",
    "op7_syncmers": "syncmers",
    "op8_secrets": "secrets",
    "op9_packing": "packing",
    "op10_jaccard": "jaccard",
    "op11_simhash": "simhash",
    "op12_merkle": "merkle",
    "op13_variants": "variants",
}


def _query(module: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: import_module(f".{module}", __package__).query(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {name: _query(module) for name, module in NAMES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f".{module}", __package__), "ORACLE_SQL", None) for name, module in NAMES.items()}
    import corpus_pipeline

    return {name: sql for name, sql in (found | {"pipeline": corpus_pipeline.ORACLE_SQL}).items() if sql}
