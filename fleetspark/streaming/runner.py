"""Run a streaming query to completion (``availableNow``) into a table.

Every micro-batch is written to its own ``_batch_id=N`` folder under the
shared checkpoint folder (``foreachBatch``, overwrite), so a batch that is
replayed after a failure replaces its own output instead of duplicating
it (exactly-once results).  ``update``-mode outputs are read back as the
latest row per key.  With ``base`` given, output and checkpoint live in a
stable place, so a rerun continues where the last run stopped; without it
each run stands alone in a fresh folder.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.state import is_missing


def stream_source(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over Parquet with the schema taken from the files."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if path.endswith(".parquet"):
        # a file stream watches a folder; select the one table by name
        folder, _, name = path.rstrip("/").rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run_to_table(stream: DataFrame, output_mode: str = "append", name: str = "stream", base: str | None = None) -> str:
    """Drain ``stream`` with ``availableNow`` and return the output path.

    ``base``: a folder of this query for resumable runs.
    """
    spark = stream.sparkSession
    out = f"{base.rstrip('/')}/out" if base else scratch_path(spark, f"{name}-out")
    ckpt = f"{base.rstrip('/')}/checkpoint" if base else scratch_path(spark, f"{name}-ckpt")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/_batch_id={batch_id}")

    q = (stream.writeStream.outputMode(output_mode).option("checkpointLocation", ckpt)
         .foreachBatch(write_batch).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def read_latest(spark: SparkSession, path: str, schema: str, key: list[str]) -> DataFrame:
    """The last emitted row per key (``update`` mode sinks)."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as error:
        if not is_missing(error):
            raise
        return spark.createDataFrame([], schema)  # nothing was emitted
    cols = [c for c in df.columns if c != "_batch_id"]
    latest = df.groupBy(*key).agg(F.max_by(F.struct(*[c for c in cols if c not in key]), "_batch_id").alias("_r"))
    return latest.select(*key, "_r.*")


def read_all(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.parquet(path).drop("_batch_id")
    except AnalysisException as error:
        if not is_missing(error):
            raise
        return spark.createDataFrame([], schema)
