"""Fixed schemas (the versioned telemetry contract and friends)."""

from __future__ import annotations

from pyspark.sql import types as T

from .fixed import TELEMETRY_EVENT, TELEMETRY_SCHEMA_VERSION  # noqa: F401


STAGE_FIELDS = ("jit_mint_secs", "sandbox_create_secs", "runner_start_secs",
                "idle_secs", "busy_secs", "teardown_secs")

DECLARED_RESOURCES = T.StructType([
    T.StructField("cpu", T.DoubleType()),
    T.StructField("memory_gib", T.DoubleType()),
    T.StructField("disk_gib", T.DoubleType()),
])

# Cycle telemetry record v1 as read from JSON.  Numbers are DOUBLE so that a
# boolean or numeric text becomes null (never cast), and schema_version 1.0
# still equals 1.  Timestamps stay ISO text as written by the producer.
_STRING_FIELDS = ("event", "cycle_id", "profile", "scope", "size_class",
                  "repository", "outcome", "termination_reason", "cleanup_status",
                  "started_at", "jit_started_at", "jit_completed_at", "sandbox_started_at",
                  "sandbox_ready_at", "runner_command_started_at", "busy_at", "completed_at",
                  "allocation_completed_at")
_DOUBLE_FIELDS = ("schema_version", "total_secs", "allocated_secs", "launch_secs") + STAGE_FIELDS

# ``snapshot`` is read as VARIANT: from_json would turn a JSON number into
# text ("5"), while the report only groups real, non-empty strings.
CYCLE_RECORD_JSON = T.StructType(
    [T.StructField(f, T.StringType()) for f in _STRING_FIELDS]
    + [T.StructField("snapshot", T.VariantType())]
    + [T.StructField(f, T.DoubleType()) for f in _DOUBLE_FIELDS]
    + [T.StructField("job_phase_observed", T.BooleanType()),
       T.StructField("runner_exit_code", T.DoubleType()),
       T.StructField("declared_resources", DECLARED_RESOURCES)]
)
