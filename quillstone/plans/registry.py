"""All queries of the library proper, by name, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.plans import event_queries, label_queries, mining_queries, model_queries, shadow_queries, tuning_queries, worker_queries

_MODULES = (event_queries, label_queries, mining_queries, model_queries, shadow_queries, tuning_queries, worker_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
