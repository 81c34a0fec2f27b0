"""Cut lineage through tables in the folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def stage(spark: SparkSession, df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The copy survives lost executors, and what follows neither recomputes
    ``df`` nor depends on how its rows were dealt out.
    """
    path = scratch_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(spark: SparkSession, docs: DataFrame, kind: str) -> DataFrame:
    """A staged copy of the rows: ``row_id`` and the whole row as struct ``row``.

    Row numbers follow how a scan is split, which may differ between two
    jobs; in the staged copy they are data.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return stage(spark, docs.select(F.monotonically_increasing_id().alias("row_id"), row), kind)
