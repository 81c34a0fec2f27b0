"""Snapshot audit from raw provider payloads and profile references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit as au
from ..sources.report import publish_report


def audit_report(payloads: DataFrame, refs: DataFrame, payload_col: str = "payload",
                 checkpoint: bool = False, pages: DataFrame | None = None, strict: bool = False) -> dict[str, DataFrame]:
    """All report sections as DataFrames (write them with
    ``sources.report.write_audit_report``).

    Items that are no objects, ids that repeat and, with ``pages`` given,
    inconsistent page headers are errors; with ``strict`` the first error
    stops the audit before anything is published.

    ``payloads``: one row per captured response (array or ``{items}``);
    ``refs``: (snapshot, fleet, profile, size_class).  The normalised
    inventory feeds six consumers; with ``checkpoint`` it is written once to
    ``spark.checkpoint.dir`` (reliable checkpoint) so the JSON is parsed
    once.
    """
    items = au.read_snapshot_payload(payloads, payload_col)
    read = au.normalize_snapshot(items.filter(F.col("raw").isNotNull()))
    errors = (items.filter(F.col("error").isNotNull()).select("error")
              .unionByName(read.filter(~F.col("is_object")).select(F.lit("snapshot is not an object").alias("error")))
              .unionByName(au.duplicate_ids(read).select(
                  F.concat(F.lit("snapshot id occurs more than once: "), F.col("snapshot_id")).alias("error"))))
    if pages is not None:
        errors = errors.unionByName(au.page_consistency(pages).select(F.concat(F.lit("inventory pages: "), F.col("violation")).alias("error")))
    if strict and (first := errors.take(1)):
        raise ValueError(f"the inventory cannot be audited: {first[0].error}")
    snaps = read.filter(F.col("is_object"))
    if checkpoint:
        snaps = snaps.checkpoint(eager=True)
    collisions = au.name_collisions(snaps)
    numbered = au.candidate_numbering(au.duplicate_candidates(snaps))
    members = au.candidate_members(snaps, numbered)
    rollup = au.candidate_rollup(members, refs)
    status = au.snapshot_reference_status(snaps, refs, collisions, members)
    unresolved = au.unresolved_refs(refs, snaps)
    unreferenced = au.unreferenced_snapshots(snaps, refs)
    return {
        "errors": errors,
        "duplicate_ids": au.duplicate_ids(snaps),
        "summary": au.audit_summary(status, unresolved, unreferenced, collisions, rollup),
        "snapshots": au.full_snapshot_rows(snaps.drop("is_object"), status),
        "profile_references": au.references_of(snaps, refs),
        "collision_references": refs.join(collisions.select(F.col("snapshot_name").alias("snapshot")), "snapshot", "left_semi"),
        "duplicate_candidates": numbered.drop("members").join(rollup, "candidate_id"),
        "candidate_members": members,
        "name_collisions": collisions,
        "collision_members": au.collision_members(snaps, collisions),
        "unresolved_profile_references": unresolved,
        "unreferenced_snapshots": unreferenced,
    }


def publish_audit(payloads: DataFrame, refs: DataFrame, base: str, payload_col: str = "payload",
                  pages: DataFrame | None = None) -> int:
    """Audit and publish under ``base``; errors of the inventory leave the published report as it is."""
    sections = audit_report(payloads, refs, payload_col, checkpoint=True, pages=pages)
    return publish_report(payloads.sparkSession, sections, base)
