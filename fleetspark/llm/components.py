"""Connected components of a link table by alternating large and small stars.

Each round joins and groups the links, writes them to the shared folder and
compares a checksum with the round before; rounds grow with the logarithm of
the longest chain.  Nothing but the checksums reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import stage


def _checksum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return (both.join(least, "a").where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hops = down.join(least, "a")
    return (hops.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(hops.select("a", F.col("m").alias("b"))).where("a <> b").distinct())


def component_labels(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``node, label`` for every linked node that is not its component's smallest.

    ``links`` has columns ``a, b`` of one orderable type; self links are ignored.
    """
    links = stage(spark, links.where("a <> b").distinct(), "links")
    before = None
    while (now := _checksum(links)) != before:
        before = now
        links = stage(spark, _small_star(_large_star(links)), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
