"""Alert state snapshots, one Parquet folder per run id.

Loading a run that was never saved gives an empty state; any other failure
to read is raised, since an empty state would send every alert again.  Saving
writes the whole next state as a new folder, never in place, so a lost
executor or a retried job cannot leave a half-written state behind.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

STATE_SCHEMA = "key string, last_alert double"


def state_path(base: str, run_id: int) -> str:
    return f"{base.rstrip('/')}/run={int(run_id)}"


def is_missing(error: AnalysisException) -> bool:
    """True if a read failed because nothing was written at the path."""
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def load_alert_state(spark: SparkSession, base: str, run_id: int) -> DataFrame:
    try:
        return spark.read.schema(STATE_SCHEMA).parquet(state_path(base, run_id))
    except AnalysisException as error:
        if not is_missing(error):
            raise
        return spark.createDataFrame([], STATE_SCHEMA)


def save_alert_state(state: DataFrame, base: str, run_id: int) -> str:
    path = state_path(base, run_id)
    state.select("key", "last_alert").write.mode("overwrite").parquet(path)
    return path


def _folder(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; empty where it does not exist."""
    fs, where = _folder(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory()] if fs.exists(where) else []


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder and what is in it; a missing one is left at that."""
    fs, where = _folder(spark, path)
    fs.delete(where, True)


def complete(spark: SparkSession, path: str) -> bool:
    """True if a job finished writing this folder."""
    fs, where = _folder(spark, f"{path.rstrip('/')}/_SUCCESS")
    return fs.exists(where)


def saved_runs(spark: SparkSession, base: str) -> list[int]:
    """Run ids whose state is complete, ascending."""
    runs = [int(n.removeprefix("run=")) for n in subfolders(spark, base) if n.startswith("run=")]
    return sorted(r for r in runs if complete(spark, state_path(base, r)))
