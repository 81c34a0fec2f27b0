"""Running (prefix) aggregates per key without one task per key.

A window ``PARTITION BY key ORDER BY t ROWS UNBOUNDED PRECEDING`` sorts a
whole key in one task; a key holding a third of the data then runs alone.
Here each key is cut into *slices* by a deterministic bucket of the order
column (for time, a fixed-width time bucket), so a hot key is spread over
as many tasks as it has buckets.  Each slice computes its local running
values; the per-slice totals (one row per key and slice, small) give each
slice its carry-in from the slices before it.  sum and max are
associative, so combining the carry-in with the local value gives the
global running value.  The bucket is a pure function of the row, so every
re-evaluation (retries, lost executors) assigns rows to the same slices.

The slice-local values are written once to the shared folder and read for
both uses, so the input is evaluated once per call however calls are nested.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


@dataclass(frozen=True)
class Running:
    name: str
    value: Column
    op: str = "sum"          # "sum" or "max"
    inclusive: bool = True   # include the current row


def _agg(op: str, c: Column) -> Column:
    return F.sum(c) if op == "sum" else F.max(c)


def _combine(op: str, carry: Column, local: Column) -> Column:
    if op == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    return F.greatest(carry, local)  # greatest skips nulls: either side may be absent


def running(df: DataFrame, key: list[str], order: list[str], specs: list[Running], bucket: Column) -> DataFrame:
    """Add one column per spec: the running sum/max of ``value`` per key in
    ``order`` (unique within a key).  ``bucket`` must be non-decreasing in
    ``order`` within a key (e.g. ``floor(epoch_secs(ts) / 3600)``)."""
    vals = [s.value.alias(f"_v_{s.name}") for s in specs]
    x = df.select("*", *vals, bucket.alias("_slice"))
    w = Window.partitionBy(*key, "_slice").orderBy(*order)
    incl = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    excl = w.rowsBetween(Window.unboundedPreceding, -1)
    x = x.select("*", *[_agg(s.op, F.col(f"_v_{s.name}")).over(incl if s.inclusive else excl)
                        .alias(f"_l_{s.name}") for s in specs])
    local = stored(df.sparkSession, x, "scan")
    totals = local.groupBy(*key, "_slice").agg(*[_agg(s.op, F.col(f"_v_{s.name}")).alias(f"_t_{s.name}") for s in specs])
    before = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*[F.col(k).alias(f"_k_{k}") for k in [*key, "_slice"]],
                          *[_agg(s.op, F.col(f"_t_{s.name}")).over(before).alias(f"_c_{s.name}") for s in specs])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*key, "_slice"]]
    return local.join(carry, on).select(*df.columns, *[_combine(s.op, F.col(f"_c_{s.name}"), F.col(f"_l_{s.name}")).alias(s.name)
                                                       for s in specs])
