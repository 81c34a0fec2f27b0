"""T-6: usage report over a stream of cycle records, kept up incrementally.

An exact nearest-rank p95 needs every value of a window, but not every
record: per window the state is a table of facts (how often each value,
outcome and allocation occurred), which merges by adding up.  A micro-batch
aggregates its own records, reads the facts of the windows it touches, adds
both and writes new versions of those windows only; the others stay as they
are.  An index per micro-batch names the version that holds for each window.

A replayed micro-batch starts from the index before it and replaces what it
wrote; versions that neither this index nor the one before names are removed.
The report is the batch ``usage_summary`` of the current facts.  With a
stable ``base`` a later run goes on where the last one stopped, and reads new
files only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import epoch_to_ts, ntz_epoch_secs
from ..operators.telemetry import merge_facts, summary_from_facts, usage_facts
from ..schemas import STAGE_FIELDS
from ..session import scratch_path
from ..sources.state import remove_folder, subfolders

RECORD_COLS = ("snapshot", "outcome", "cleanup_status", "total_secs", "allocated_secs", "cpu", "memory_gib",
               "disk_gib") + STAGE_FIELDS
WINDOW = "window_start"
FACT_SCHEMA = ("window_start timestamp_ntz, snapshot string, field string, v double, c long, cpu_s decimal(38,6), "
               "ram_s decimal(38,6), disk_s decimal(38,6)")


def windowed_records(cycles: DataFrame, window_secs: int, ts_col: str = "completed_at") -> DataFrame:
    """Window start (epoch-aligned, UTC wall clock) plus what the summary reads."""
    start = epoch_to_ts(F.floor(ntz_epoch_secs(ts_col) / window_secs) * window_secs)
    cols = [F.col(c) if c in cycles.columns else F.lit(None).cast("double").alias(c) for c in RECORD_COLS]
    return cycles.select(start.alias(WINDOW), *cols)


class FactTable:
    """Versions of facts per window under ``base``: ``facts/batch=N/window=E`` and ``index/batch=N``."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.facts, self.index = spark, f"{base.rstrip('/')}/facts", f"{base.rstrip('/')}/index"

    def versions(self, before: int | None = None) -> dict[int, int]:
        """Window (epoch seconds, one row each) -> batch that wrote it, by the last index (before a batch)."""
        batches = [int(n.removeprefix("batch=")) for n in subfolders(self.spark, self.index) if n.startswith("batch=")]
        batches = [b for b in batches if before is None or b < before]
        if not batches:
            return {}
        rows = self.spark.read.schema("window long, version long").parquet(f"{self.index}/batch={max(batches)}")
        return {r["window"]: r["version"] for r in rows.collect()}

    def read(self, versions: dict[int, int]) -> DataFrame:
        """The facts of these windows; nothing else is opened."""
        paths = [f"{self.facts}/batch={b}/window={w}" for w, b in versions.items()]
        return self.spark.read.schema(FACT_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], FACT_SCHEMA)

    def add(self, records: DataFrame, batch_id: int) -> None:
        """Merge a micro-batch's records into the windows they touch."""
        new = usage_facts(records, [WINDOW]).withColumn("window", ntz_epoch_secs(WINDOW).cast("long"))
        held = self.versions(before=batch_id)
        own = f"{self.facts}/batch={batch_id}"
        new.write.mode("overwrite").partitionBy("window").parquet(f"{own}-new")
        touched = [int(n.removeprefix("window=")) for n in subfolders(self.spark, f"{own}-new") if n.startswith("window=")]
        old = self.read({w: held[w] for w in touched if w in held})
        fresh = self.spark.read.schema(FACT_SCHEMA).parquet(f"{own}-new").drop("window")
        merged = merge_facts(old.unionByName(fresh), [WINDOW]).withColumn("window", ntz_epoch_secs(WINDOW).cast("long"))
        merged.write.mode("overwrite").partitionBy("window").parquet(own)
        now = held | {w: batch_id for w in touched}
        listed = self.spark.createDataFrame(list(now.items()), "window long, version long")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.index}/batch={batch_id}")
        remove_folder(self.spark, f"{own}-new")
        self._compact(batch_id, held, now)

    def _compact(self, batch_id: int, held: dict[int, int], now: dict[int, int]) -> None:
        """Drop indexes before the last two, and versions that neither of these names."""
        kept = set(held.items()) | set(now.items())
        for name in subfolders(self.spark, self.facts):
            batch = int(name.removeprefix("batch=").removesuffix("-new"))
            for window in subfolders(self.spark, f"{self.facts}/{name}"):
                if (int(window.removeprefix("window=")), batch) not in kept:
                    remove_folder(self.spark, f"{self.facts}/{name}/{window}")
            if batch not in {b for _, b in kept}:
                remove_folder(self.spark, f"{self.facts}/{name}")
        indexes = sorted(int(n.removeprefix("batch=")) for n in subfolders(self.spark, self.index))
        for batch in [b for b in indexes if b < batch_id][:-1]:
            remove_folder(self.spark, f"{self.index}/batch={batch}")


def usage_report_stream(cycles_stream: DataFrame, window_secs: int, base: str | None = None) -> DataFrame:
    """Drain the stream (``availableNow``) into the facts under ``base`` and return the summary per window."""
    spark = cycles_stream.sparkSession
    base = base or scratch_path(spark, "usage")
    table = FactTable(spark, base)
    query = (windowed_records(cycles_stream, window_secs).writeStream
             .option("checkpointLocation", f"{base.rstrip('/')}/checkpoint").foreachBatch(table.add).trigger(availableNow=True).start())
    query.awaitTermination()
    return summary_from_facts(table.read(table.versions()), [WINDOW])
