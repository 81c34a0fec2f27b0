"""Registered queries: name -> (spark builder, DuckDB oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over
the driver tables (through the fixture views).  The oracle is independent
SQL over the same views; column names match the Spark output exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from .plans import (queries_audit, queries_config, queries_cycles, queries_demand,  # noqa: F401
                        queries_health, queries_profiles, queries_telemetry, queries_text, queries_webhook)
    from .plans import queries_streams  # noqa: F401  (reuses oracles registered above)
