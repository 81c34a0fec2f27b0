"""Consecutive numbers along an order, without one task that sees a whole group.

Rows are dealt to sampled ranges of (group, order), sorted there and staged
with their range and place; the counts of a group's rows per range give each
range its first number.  A group of any size therefore spreads over as many
ranges as it fills, and a window only ever sees one row per (group, range).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

_SLOT_BITS = 33  # monotonically_increasing_id counts the rows of a partition in these bits
_OWN = ("_row", "_part", "_slot")


def number_rows(df: DataFrame, order: list[str], group: list[str] | None = None, name: str = "number") -> DataFrame:
    """``df`` with ``name`` = 1, 2, 3 … per ``group`` (columns) along ``order`` (columns, ascending, nulls first).

    Rows equal in all of ``order`` are numbered in some order of their own;
    nulls of ``group`` form one group.  The rows are staged twice in the
    shared folder (their own place first, so that equal rows can be told
    apart and spread), hence pass narrow rows.  An empty table stays empty.
    """
    spark, group = df.sparkSession, list(group or [])
    clash = [c for c in df.columns if c in (*_OWN, name)]
    if clash:
        raise ValueError(f"columns {clash} are used by the numbering")
    keys = [F.col(f"`{c}`") for c in [*group, *order]] + [F.col("_row")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(spark, df.withColumn("_row", F.monotonically_increasing_id()), "numbering-rows")
    placed = stored(spark, rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_row")
                    .withColumn("_part", F.spark_partition_id())
                    .withColumn("_slot", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))), "numbering")
    columns = [F.col(f"`{c}`") for c in group]
    ranges = placed.groupBy(*columns, "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_slot").alias("first_slot"))
    earlier = Window.partitionBy(*columns) if group else Window.partitionBy(F.lit(0))
    earlier = earlier.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    same = F.col("d._part") == F.col("r._part")
    for c in group:
        same &= F.col(f"d.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
    place = (F.col("_slot") - F.col("first_slot") + F.col("before") + 1).cast("long").alias(name)
    return placed.alias("d").join(ranges.alias("r"), same).select(*[F.col(f"d.`{c}`") for c in df.columns], place)
