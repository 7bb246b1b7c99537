"""All queries of the library on the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import aggregates, building, choices, extras, generated, joins, labels, masked, rankers, reports, search, streams, windows

MODULES = (joins, aggregates, windows, choices, reports, extras, labels, rankers, search, building, generated, masked, streams)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: s for m in MODULES for k, s in m.ORACLE.items()}
