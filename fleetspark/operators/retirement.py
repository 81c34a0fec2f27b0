"""Snapshot retirement candidates (documented policy, no reference code).

An unreferenced snapshot may retire when its quiet period has passed:
7 days for a failed build; 14 days when every fleet that used it has
completed at least 100 successful cycles on the replacement; 30 days
otherwise.  An open incident retains it; a
resolved one restarts the period.  Anything ambiguous (unknown age,
referenced, name collision) is retained.  One keyed join of three inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import DEFAULT_DAYS, FAILED_BUILD_DAYS, MIN_REPLACEMENT_SUCCESSES, REPLACED_DAYS  # noqa: F401


def replacement_successes(cycles: DataFrame, history: DataFrame, affected: DataFrame) -> DataFrame:
    """``snapshot_id, successes``: the fewest successful (outcome 'job') cycles
    that any affected fleet completed on the snapshot's replacement.

    ``cycles`` has (fleet, snapshot, outcome), ``affected`` (snapshot_id,
    fleet): the fleets that referenced the snapshot.
    """
    done = (cycles.filter(F.col("outcome") == "job").groupBy(F.col("snapshot").alias("replacement"), "fleet")
            .agg(F.count(F.lit(1)).alias("_n")))
    return (affected.join(history.select("snapshot_id", "replacement"), "snapshot_id")
            .join(done, ["replacement", "fleet"], "left")
            .groupBy("snapshot_id").agg(F.min(F.coalesce("_n", F.lit(0))).alias("successes")))


def retirement_candidates(status: DataFrame, history: DataFrame, successes: DataFrame) -> DataFrame:
    """(snapshot_id, decision, reason) for every snapshot with a status row."""
    h = history.join(successes, "snapshot_id", "left")
    j = status.select("snapshot_id", "reference_status").join(h, "snapshot_id", "left")
    age = F.when(F.col("incident") == "resolved",
                 F.least(F.col("unreferenced_days"), F.col("incident_resolved_days"))).otherwise(F.col("unreferenced_days"))
    ok_replacement = F.coalesce(F.col("successes"), F.lit(0)) >= MIN_REPLACEMENT_SUCCESSES
    reason = (F.when(F.col("reference_status") != "unreferenced", F.col("reference_status"))
              .when(F.col("unreferenced_days").isNull() | F.col("build_failed").isNull(), "ambiguous")
              .when(F.col("incident") == "open", "open_incident")
              .when(F.col("build_failed"), F.when(age >= FAILED_BUILD_DAYS, "failed_build").otherwise("failed_build_recent"))
              .when(F.col("replacement").isNotNull() & ok_replacement,
                    F.when(age >= REPLACED_DAYS, "replaced").otherwise("replaced_recent"))
              .when(age >= DEFAULT_DAYS, "unreferenced_30d").otherwise("unreferenced_recent"))
    decision = F.when(reason.isin("failed_build", "replaced", "unreferenced_30d"), "retire").otherwise("retain")
    return j.select("snapshot_id", decision.alias("decision"), reason.alias("reason"))
