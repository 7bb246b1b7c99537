"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("byte_bpe", "packing", "quality_rules", "jaccard_rtree", "toxicity", "language_id", "pii", "url_filters", "licenses", "local_descriptors", "importance", "spelling", "nb_svm")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in import_module(f"tidemark.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"tidemark.llm.{m}").ORACLE.items()}
