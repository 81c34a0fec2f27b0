"""Write the snapshot audit report as JSON datasets, one per section.

Each row is written with its allow-listed fields in sorted key order (the
reference's ``json.dumps(sort_keys=True)``).  Member lists are separate
sections keyed by their group, so no row carries an unbounded array.

A published report is versioned: the sections go to a fresh folder, the gate
reads what was written, and only then one small folder names the version as
published.  A report that fails the gate, or a job that dies on the way,
leaves the one before readable, whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .state import complete, remove_folder, subfolders

#: Published versions that stay.
KEPT_VERSIONS = 3


def sorted_json(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One ``json`` text column with the chosen fields in sorted order; nulls kept."""
    names = sorted(fields or df.columns)
    return df.select(F.to_json(F.struct(*[F.col(n) for n in names]), {"ignoreNullFields": "false"}).alias("json"))


def write_audit_report(sections: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Write each section under ``path/<section>`` as text JSON lines."""
    out = {}
    for name, df in sections.items():
        target = f"{path.rstrip('/')}/{name}"
        sorted_json(df).write.mode("overwrite").text(target)
        out[name] = target
    return out


class RejectedReport(ValueError):
    """The gate found errors; nothing was published."""


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removeprefix("v=")) for n in subfolders(spark, path) if n.startswith("v="))


def published_version(spark: SparkSession, base: str) -> int | None:
    """The version that readers see: the last one whose naming was completed."""
    named = f"{base.rstrip('/')}/published"
    done = [v for v in _numbers(spark, named) if complete(spark, f"{named}/v={v}")]
    return done[-1] if done else None


def publish_report(spark: SparkSession, sections: dict[str, DataFrame], base: str, errors: str = "errors") -> int:
    """Write a version, gate it on its ``errors`` section, publish it; returns the version.

    With any row of errors the version is removed and :class:`RejectedReport`
    names the first of them by text; the published version stays as it is.
    """
    base = base.rstrip("/")
    version = max([0, *_numbers(spark, f"{base}/versions"), *_numbers(spark, f"{base}/published")]) + 1
    paths = write_audit_report(sections, f"{base}/versions/v={version}")
    if first := spark.read.text(paths[errors]).orderBy("value").take(1):
        remove_folder(spark, f"{base}/versions/v={version}")
        raise RejectedReport(f"the report is not published: {first[0].value}")
    listed = spark.createDataFrame([(n,) for n in sorted(sections)], "section string")
    listed.coalesce(1).write.parquet(f"{base}/published/v={version}")
    for old in _numbers(spark, f"{base}/published")[:-KEPT_VERSIONS]:
        remove_folder(spark, f"{base}/published/v={old}")
    kept = set(_numbers(spark, f"{base}/published"))
    for old in _numbers(spark, f"{base}/versions"):
        if old not in kept and old < version:
            remove_folder(spark, f"{base}/versions/v={old}")
    return version


def read_published(spark: SparkSession, base: str, section: str) -> DataFrame:
    """A section of the published report as JSON text lines (``value``)."""
    version = published_version(spark, base)
    if version is None:
        raise LookupError(f"no report is published under {base}")
    return spark.read.text(f"{base.rstrip('/')}/versions/v={version}/{section}")
