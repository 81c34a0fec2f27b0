"""The training-data pipeline over ``documents``: five stages, each a whole operator.

Every stage but the last returns the columns of ``documents``:

* quality rules: documents that the current policy rejects go;
* SimHash near-dedup: one document of each near-duplicate group stays;
* secret scans: secrets are replaced in the text, every document stays;
* mixing: documents repeat or go until each source is near its target;
* packing: the result, pieces of documents in windows of 4096 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetspark.llm.mixing import mixing_stage
from fleetspark.llm.packing import packing_stage
from fleetspark.llm.quality_rules import quality_stage
from fleetspark.llm.secret_scan import secret_stage
from fleetspark.llm.simhash import simhash_stage
from fleetspark.llm.staging import stage

STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", simhash_stage),
    ("secret_scan", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL has no XXH64, automata or tokenizers; ``tests/llm`` holds the run against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(spark, function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
