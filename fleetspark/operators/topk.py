"""Bounded top-k per group without gathering a whole group in one task.

Stage 1 ranks inside (group, salt) sub-groups and keeps k rows each; stage
2 ranks the at most ``k * salts`` survivors per group.  A group holding a
third of all rows is therefore split over ``salts`` tasks, and no stage
materialises more than ``k * salts`` rows per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SALTS = 64


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int,
          salts: int = DEFAULT_SALTS, rank_col: str = "rank") -> DataFrame:
    if not keys:
        # One global group: ``orderBy().limit(k)`` plans as TakeOrderedAndProject
        # (each task keeps its own k best, then one merge of k x tasks rows).
        best = df.orderBy(*order).limit(k)
        return best.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))
    # the partition spreads equal rows, which share a hash; both are the same when a task is repeated
    own = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts))
    salt = ((own + F.spark_partition_id()) % salts).alias("_salt")
    staged = df.select("*", salt)
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    pre = staged.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return pre.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= k)


def joined_top(df: DataFrame, keys: list[str], value: str, k: int, sep: str = ", ",
               order: list[Column] | None = None, out_col: str = "names") -> DataFrame:
    """The first ``k`` values (in ``order``, default value order) joined by ``sep``."""
    order = order or [F.col(value)]
    top = top_k(df, keys, order, k)
    agg = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", value))).alias("_t"))
    return agg.select(*keys, F.concat_ws(sep, F.transform("_t", lambda x: x[value])).alias(out_col))


def joined_top_global(df: DataFrame, value: str, k: int, sep: str = ", ",
                      order: list[Column] | None = None, out_col: str = "names") -> DataFrame:
    """P24 over the whole frame: one row with the first ``k`` values joined
    (no row when the frame is empty)."""
    order = order or [F.col(value)]
    top = top_k(df, [], order, k)
    return (top.agg(F.array_sort(F.collect_list(F.struct("rank", value))).alias("_t"))
            .filter(F.size("_t") > 0)
            .select(F.concat_ws(sep, F.transform("_t", lambda x: x[value])).alias(out_col)))
