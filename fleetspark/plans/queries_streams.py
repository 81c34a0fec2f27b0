"""Registered streaming queries: each drains a file stream of the driver
table with ``availableNow`` and returns the written result (T-1 to T-7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import ORACLES, register
from ..operators.labels import label_sets
from ..sources.fixtures import fixture_stream, oracle_with
from ..streaming import cycle_state as cs
from ..streaming import deliveries as ds
from ..streaming.runner import read_all, read_latest, run_to_table
from .queries_cycles import IDLE_DEADLINE, JOB_MAX, TIMER_ORACLE
from .queries_webhook import CLASS_LABELS, SECRET, WAKE_INTERVAL, _sender_signature


def _requests_stream(spark, sf):
    r = fixture_stream(spark, sf, "fx_webhook_requests")
    return r.withColumn("signature", _sender_signature(F.col("body"), F.col("event_id")))


def _delivery_stream(spark, sf):
    sets = label_sets(CLASS_LABELS)
    return ds.delivery_stream(_requests_stream(spark, sf), SECRET, sets)


def _delivery(spark, sf):
    out = run_to_table(_delivery_stream(spark, sf), "append", "deliveries")
    return read_all(spark, out, "event_id long, ts timestamp_ntz, signature_ok boolean, status int, wake boolean") \
        .select("event_id", "status", "wake")


def _wake(spark, sf):
    stream = ds.wake_windows(_delivery_stream(spark, sf), WAKE_INTERVAL, "1 hour")
    out = run_to_table(stream, "update", "wake")
    return read_latest(spark, out, "window_start timestamp_ntz, wake boolean, matching long", ["window_start"])


def _cycles(spark, sf):
    stream = cs.cycle_state_stream(fixture_stream(spark, sf, "fx_cycle_events"))
    out = run_to_table(stream, "update", "cycle-state")
    return read_latest(spark, out, cs.OUTPUT_SCHEMA, ["cycle_id"])


register("delivery_stream", ORACLES["classify_delivery"])(_delivery)
register("wake_coalesce_stream", ORACLES["wake_coalesce"])(_wake)
register("cycle_state_stream", ORACLES["cycle_state"])(_cycles)


def _usage_stream(spark, sf):
    from ..streaming.usage import usage_report_stream
    return usage_report_stream(fixture_stream(spark, sf, "fx_cycles"), 86400)


def _usage_stream_oracle() -> str:
    from .queries_telemetry import _summary_sql
    ctes, body = _summary_sql(["window_start"])
    return oracle_with(["fx_cycles"], f"""
, cyc AS (SELECT date_trunc('day', completed_at) AS window_start, * FROM fx_cycles),
{ctes}
SELECT * FROM ({body}) s""")


def _streak(spark, sf):
    from ..streaming.failure_streak import OUTPUT_SCHEMA, failure_streak_stream
    out = run_to_table(failure_streak_stream(fixture_stream(spark, sf, "fx_polls")), "append", "failure-streak")
    return read_all(spark, out, OUTPUT_SCHEMA)


register("usage_report_stream", _usage_stream_oracle())(_usage_stream)
register("failure_streak_stream", ORACLES["failure_runs"])(_streak)


def _timers(spark, sf):
    from ..streaming.timers import OUTPUT_SCHEMA, deadline_timer_stream
    stream = deadline_timer_stream(fixture_stream(spark, sf, "fx_timer_events"), IDLE_DEADLINE, JOB_MAX)
    return read_all(spark, run_to_table(stream, "append", "timers"), OUTPUT_SCHEMA)


register("deadline_timers_stream", TIMER_ORACLE)(_timers)


REALERT_DAYS = 7


def _alert_passes(spark, sf):
    from ..session import scratch_path
    from ..streaming.alerts import alert_stream
    out = scratch_path(spark, "alerts-out")
    alert_stream(fixture_stream(spark, sf, "fx_alert_passes"), REALERT_DAYS * 86400, scratch_path(spark, "alerts-state"), out
                 ).awaitTermination()
    return (spark.read.option("basePath", out).schema("key string, text string, status string, last_alert double, pass_id long")
            .parquet(f"{out}/pass_id=*").select("pass_id", "key", "text", "status", "last_alert"))


# Passes are five days apart, so of a stretch of passes with a key every second one alerts anew.
register("alert_transitions_stream", oracle_with(["fx_alert_passes"], """
, k AS (SELECT DISTINCT pass_id, now_epoch, key, text FROM fx_alert_passes WHERE key IS NOT NULL),
g AS (SELECT *, pass_id - row_number() OVER (PARTITION BY key ORDER BY pass_id) AS island FROM k),
p AS (SELECT *, row_number() OVER (PARTITION BY key, island ORDER BY pass_id) - 1 AS nth FROM g),
ends AS (SELECT key, max(pass_id) + 1 AS pass_id FROM g GROUP BY key, island)
SELECT pass_id, key, text, CASE WHEN nth % 2 = 0 THEN 'fresh' ELSE 'suppressed' END AS status,
       now_epoch - 432000.0 * (nth % 2) AS last_alert FROM p
UNION ALL SELECT pass_id, key, NULL, 'recovered', NULL FROM ends WHERE pass_id <= (SELECT max(pass_id) FROM fx_alert_passes)
"""))(_alert_passes)
