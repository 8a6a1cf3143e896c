"""Registry of driver queries: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}

# Fixed clocks replacing NOW() so results are reproducible.
AS_OF_ORDERS = _dt.datetime(2001, 12, 1, 0, 0, 0)
AS_OF_EVENTS = _dt.datetime(2024, 1, 31, 0, 0, 0)
AS_OF_ORDERS_SQL = "TIMESTAMP '2001-12-01 00:00:00'"
AS_OF_EVENTS_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLE[name] = oracle
        return fn
    return deco


def _load() -> None:
    # Import for side effects: each module registers its queries.
    from intakeflow.plans import (q_clean, q_drift, q_ingest, q_ledger, q_quality,  # noqa: F401
                                  q_reports, q_sequence, q_sources)


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
