"""Session helpers: one place for the configuration the operators assume."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on.  Timestamps in the fixture tables are
# TIMESTAMP_NTZ, so results never depend on the session zone; UTC is pinned
# anyway so ISO text rendered from instants is stable.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "fleetspark") -> SparkSession:
    """Local session for tests and the bench; a cluster passes its own conf."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.driver.memory", os.environ.get("FLEETSPARK_DRIVER_MEM", "16g"))
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS/S3/ABFS) folder there.  Only a local
    session without the setting gets a folder of its own; on a cluster a
    missing setting is an error, since executors share no local folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = os.path.join(os.environ.get("TMPDIR", "/tmp"), "fleetspark-checkpoints")
        spark.conf.set("spark.checkpoint.dir", configured)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def stored(spark: SparkSession, df, kind: str):
    """Write a frame once as Parquet under the shared folder and read it back:
    a plan that uses it several times, or builds on itself, stays small, and
    the copy survives lost executors."""
    path = scratch_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh path under the shared checkpoint folder (stream sinks, state)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/fleetspark/{kind}/{uuid.uuid4().hex}"
