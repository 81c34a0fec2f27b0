"""Mix sources to target weights by systematic sampling (DataFrame functions only).

Every source gets a target from its weight, capped at ``MAX_REPEAT`` times
its size; the excess goes to the others by weight.  All documents of a source
expect the same number of copies, ``target / size``.  In each source the
documents stand in order of size, the expected copies are summed up before
each document, one random offset is added, and a document is emitted once per
integer boundary that its stretch crosses.  Standing in order of size, the
error of the words taken stays below about one large document.

Ranks in a source come from a range-partitioned table and per-partition
counts, so a source with a third of all rows is spread over many tasks.

Defined cases: null or blank text has size 0 and is emitted like any other
document, taking 0 words; null is a source of its own, last in order; a
source whose documents have no words has target 0; repeated rows are
documents of their own; an empty table gives an empty result.  Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import read, register
from .staging import numbered, stage
from .text import n_words

MAX_REPEAT = 3
SEED = 20
#: Up to so many runs (a source in a partition) are broadcast; beyond that they are joined by shuffle.
BROADCAST_RUNS = 100_000
_SLOT_BITS = 33  # monotonically_increasing_id counts rows of a partition in these bits


def source_targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT, cycle: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Weights run 1..cycle over the sources by code point, null last.  With the
    sources ordered by cap per weight, the common level is the largest of
    "what is left / weight left" along that order: it rises while sources
    reach their cap and falls afterwards.  One row per source, so the two
    unpartitioned windows hold source names only.
    """
    ranked = sizes.withColumn("w", (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1,
                                           F.lit(cycle)) + 1).cast("double"))
    ranked = ranked.withColumn("cap", F.lit(max_repeat) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (ranked
              .withColumn("left_size", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
              .withColumn("left_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    levels = levels.withColumn("level", F.max(F.col("left_size").cast("double") / F.col("left_w")).over(every))
    return levels.select("source", "source_size",
                         F.least(F.col("cap").cast("double"), F.col("w") * F.col("level")).alias("target"))


def random_offset(source: Column, seed: int = SEED) -> Column:
    """One number in [0, 1) per source, the same in every run."""
    name = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def copies(rank: Column, rate: Column, offset: Column, max_repeat: int = MAX_REPEAT) -> Column:
    """Integer boundaries crossed by the document of 0-based ``rank``."""
    crossed = F.floor((rank + 1) * rate + offset) - F.floor(rank * rate + offset)
    return F.least(crossed, F.lit(max_repeat).cast("long"))


def mix(spark: SparkSession, sized: DataFrame, seed: int = SEED, max_repeat: int = MAX_REPEAT,
        broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    """Adds ``source_size, target, copies`` to ``row_id, doc_id, source, size``.

    ``row_id`` tells repeated rows apart.  The sized rows are staged, so that
    the sampling of the range partitioning does not count words again, and
    the ranked rows are: partition numbers must not change between their two
    uses.  The ranked rows, a few bytes each as a sorted file, are never
    broadcast; the runs are while they are few.
    """
    order = ["source", "size", "doc_id", "row_id"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (stage(spark, sized.select(*order), "mixing-sizes").repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("part", F.spark_partition_id())
              .withColumn("slot", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))))
    placed = stage(spark, placed, "mixing")
    runs = placed.groupBy("source", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("slot").alias("first_slot"), F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    sources = source_targets(runs.groupBy("source").agg(F.sum("part_size").alias("source_size")), max_repeat)
    runs = (runs.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
            .select("r.source", "r.part", "first_slot", "start", "source_size", "target"))
    runs = stage(spark, runs, "mixing-runs")
    few = runs.limit(broadcast_runs + 1).count() <= broadcast_runs
    runs = F.broadcast(runs) if few else runs.hint("merge")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (placed.alias("d")
            .join(runs.alias("r"), (F.col("d.part") == F.col("r.part")) & F.col("d.source").eqNullSafe(F.col("r.source")))
            .select("d.row_id", "d.doc_id", "d.source", "d.size", "source_size", "target",
                    copies(F.col("slot") - F.col("first_slot") + F.col("start"), rate,
                           random_offset(F.col("d.source"), seed), max_repeat).alias("copies")))


def sized_rows(docs: DataFrame) -> DataFrame:
    """``row_id, doc_id, source, size`` of a documents table."""
    return docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))


_SQL = rf"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w,
         {MAX_REPEAT} * source_size AS cap FROM z),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS DOUBLE)
            / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lvl
  FROM w WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / w, source ASC NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), w * max(lvl) OVER ()) AS target,
         CAST(('0x' || substr(md5('{SEED}:' || coalesce('s' || source, 'n')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) - 1 AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * least(floor((i + 1) * rate + u) - floor(i * rate + u), {MAX_REPEAT}) AS BIGINT) AS taken
FROM r
"""


@register("op2_mix_sources", _SQL)
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes from every document."""
    mixed = mix(spark, sized_rows(read(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it."""
    rows = numbered(spark, docs, "mixing-rows")
    sized = rows.select("row_id", F.col("row.doc_id").cast("long").alias("doc_id"),
                        F.col("row.source").cast("string").alias("source"), n_words(F.col("row.text")).alias("size"))
    mixed = mix(spark, sized).where(F.col("copies") > 0).select("row_id", "copies")
    return (rows.join(mixed, "row_id")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*"))
