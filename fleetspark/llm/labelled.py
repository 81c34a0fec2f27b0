"""Rows of documents with a 0/1 label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labels are broadcast up to this many rows (a long and an int each), and joined by shuffle beyond.
BROADCAST_ROWS = 500_000


def with_label(docs: DataFrame, labels: DataFrame, name: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` that have a label 0 or 1 in ``labels.name``, as column ``label``.

    Documents are only read, not shuffled, while the labels are few.  Of
    several labels for one id the greatest holds.
    """
    known = (labels.where(F.col(name).isin(0, 1) & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(name).cast("int")).alias("label")))
    few = labels.limit(broadcast_rows + 1).count() <= broadcast_rows
    return docs.join(F.broadcast(known) if few else known, "doc_id")
