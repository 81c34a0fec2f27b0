"""T-1 on a stream: alert transitions per watchdog pass with ``foreachBatch``.

Rows are (pass_id, now_epoch, key, text); a row without a key ends its pass.
A pass may arrive in several micro-batches: findings are kept in a log, one
folder per pass and micro-batch, and a pass is worked out once, whole, when
its end arrives; a pass without findings is its end row alone, and reports
what recovered.  Passes are applied in order, each against the state of the
pass applied before it.

The saved state marks its pass as applied: a replayed micro-batch leaves such
passes alone, and findings that come for them later are no longer heard.
Then the pass leaves the log, and of the states the last ``KEPT_STATES``
stay, so that neither grows with the life of the stream.  Pass ids ascend as
long as a state folder lives.

Only the end rows of a micro-batch come to the driver, one per pass; bound
them with ``maxFilesPerTrigger`` on the source.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts as al
from ..session import scratch_path
from ..sources.state import is_missing, load_alert_state, remove_folder, save_alert_state, saved_runs, state_path, subfolders

KEPT_STATES = 2


def _findings_of(spark: SparkSession, log: str, pass_id: int) -> DataFrame:
    """The findings of one pass from all micro-batches so far; only its own folder is read."""
    try:
        rows = spark.read.schema("key string, text string").parquet(f"{log}/pass_id={int(pass_id)}/batch=*")
    except AnalysisException as error:
        if not is_missing(error):
            raise
        rows = spark.createDataFrame([], "key string, text string")
    return rows.groupBy("key").agg(F.min("text").alias("text"))


def _log_findings(batch: DataFrame, log: str, batch_id: int, applied: int | None) -> None:
    """Add a micro-batch to the log, one folder per pass; a replay replaces its own folders."""
    spark = batch.sparkSession
    found = batch.where(F.col("key").isNotNull()).select("pass_id", "key", "text")
    if applied is not None:
        found = found.where(F.col("pass_id") > applied)
    # of all folders only those of this micro-batch are replaced
    found.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("pass_id", "batch").parquet(log)


def _compact(spark: SparkSession, log: str, states: str, applied: int) -> None:
    """Remove applied passes from the log, and states that no pass needs any more."""
    for name in subfolders(spark, log):
        if name.startswith("pass_id=") and int(name.removeprefix("pass_id=")) <= applied:
            remove_folder(spark, f"{log}/{name}")
    for run in saved_runs(spark, states)[:-KEPT_STATES]:
        remove_folder(spark, state_path(states, run))


def alert_stream(findings: DataFrame, realert_secs: int, state_base: str, out_path: str,
                 checkpoint: str | None = None):
    """Start the query (``availableNow``); the transitions of each ended pass
    are a folder of ``out_path``.  Returns the started query."""
    spark = findings.sparkSession
    base = state_base.rstrip("/")
    log, states = f"{base}/findings", f"{base}/states"

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        runs = saved_runs(spark, states)
        applied = runs[-1] if runs else None
        _log_findings(batch, log, batch_id, applied)
        ended = batch.filter(F.col("key").isNull()).select("pass_id", "now_epoch").distinct().orderBy("pass_id")
        for r in ended.toLocalIterator():
            if applied is not None and r.pass_id <= applied:
                continue
            prev = load_alert_state(spark, states, r.pass_id - 1 if applied is None else applied)
            t = al.alert_transitions(_findings_of(spark, log, r.pass_id), prev, float(r.now_epoch), realert_secs)
            out = f"{out_path}/pass_id={r.pass_id}"
            t.write.mode("overwrite").parquet(out)
            save_alert_state(al.next_state(spark.read.schema(t.schema).parquet(out)), states, r.pass_id)
            applied = r.pass_id
        if applied is not None:
            _compact(spark, log, states, applied)

    return (findings.writeStream.foreachBatch(per_batch)
            .option("checkpointLocation", checkpoint or scratch_path(spark, "alerts-ckpt"))
            .trigger(availableNow=True).start())
