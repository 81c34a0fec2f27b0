"""Registered queries of this subpackage: name -> builder, name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Add a query; ``oracle`` only where SQL can express the result."""
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, lazily, through Spark's reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_all() -> None:
    """Import every operator module, which registers its query."""
    import importlib
    for module in MODULES:
        importlib.import_module(f"{__package__}.{module}")


MODULES = ["packing", "mixing", "quality_rules", "suffix_dedup", "toxicity", "secret_scan", "quality_knn", "language_id",
           "simhash", "topk_search", "sanitise", "periodic", "importance"]
