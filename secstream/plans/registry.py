"""Registry of query keys: a Spark builder and (when exact) an oracle SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query key {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers query keys."""
    from . import (  # noqa: F401
        q_context,
        q_detections,
        q_features,
        q_incidents,
        q_ingest,
        q_policy,
        q_search,
        q_similarity,
        q_sinks,
        q_streaming,
        q_triage,
    )
