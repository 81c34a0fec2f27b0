"""Registered cycle / request-log queries (P4-P9, T-3, T-4, W5, P19, W6, W7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..functions.core import ntz_epoch_secs, ts_lit
from ..operators import apilog as ap
from ..operators import cycles as cy
from ..sources.fixtures import EVENTS_AS_OF, fixture, oracle_with

HOLD_SECS = 600
IDLE_DEADLINE = 6 * 3600
JOB_MAX = 2 * 24 * 3600
SPACING = 300.0


def _marks(spark, sf):
    m = fixture(spark, sf, "fx_cycle_marks")
    oc = cy.classify_outcome(F.col("ended_by"), F.col("busy_at"), F.col("exit_code"))
    return m.withColumn("_oc", oc).select("*", "_oc.*").drop("_oc")


_OUTCOME = """CASE WHEN ended_by = 'session_unreadable' THEN CASE WHEN busy_at IS NOT NULL THEN 'job' ELSE 'unknown' END
     WHEN ended_by = 'runner_exit' THEN CASE WHEN busy_at IS NOT NULL OR exit_code = 0 THEN 'job' ELSE 'failed' END
     WHEN ended_by = 'job_max' THEN 'job' WHEN ended_by IN ('drain', 'quiesce', 'idle_deadline') THEN 'idle'
     ELSE 'failed' END"""
_REASON = """CASE WHEN ended_by = 'job_max' THEN 'job_max_secs'
     WHEN ended_by IN ('session_unreadable', 'runner_exit', 'drain', 'quiesce', 'idle_deadline') THEN ended_by
     ELSE 'cycle_failed' END"""
_M = f"m AS (SELECT *, {_OUTCOME} AS outcome, {_REASON} AS termination_reason FROM fx_cycle_marks)"

register("classify_outcome", oracle_with(["fx_cycle_marks"], f", {_M} SELECT cycle_id, outcome, termination_reason FROM m"))(
    lambda spark, sf: _marks(spark, sf).select("cycle_id", "outcome", "termination_reason"))

register("classify_cleanup", oracle_with(["fx_cycle_marks"], """
SELECT cycle_id, cs AS cleanup_status,
       NOT (jit_attempted AND NOT runner_registered) AND NOT (create_attempted AND NOT sandbox_created)
       AND cs <> 'delete_failed' AS cleanup_complete
FROM (SELECT *, CASE WHEN sandbox_created THEN CASE WHEN delete_failed THEN 'delete_failed' ELSE 'deleted' END
                     WHEN create_attempted THEN 'create_unconfirmed' ELSE 'create_not_attempted' END AS cs
      FROM fx_cycle_marks) x
"""))(lambda spark, sf: fixture(spark, sf, "fx_cycle_marks").select(
    "cycle_id", cy.classify_cleanup(F.col("create_attempted"), F.col("sandbox_created"), F.col("delete_failed"),
                                    F.col("jit_attempted"), F.col("runner_registered")).alias("c")).select("cycle_id", "c.*"))

register("hold_eligible", oracle_with(["fx_cycle_marks"], f"""
, {_M} SELECT cycle_id FROM m WHERE sandbox_created AND (outcome = 'failed' OR coalesce(exit_code <> 0, false))
"""))(lambda spark, sf: _marks(spark, sf).filter(
    cy.hold_eligible(F.col("sandbox_created"), HOLD_SECS, F.col("outcome"), F.col("exit_code"))).select("cycle_id"))

register("profile_of", oracle_with(["fx_cycle_marks"], """
SELECT cycle_id, coalesce(nullif(label_fleet, ''), nullif(label_org, ''), 'fleet-default') AS profile FROM fx_cycle_marks
"""))(lambda spark, sf: fixture(spark, sf, "fx_cycle_marks").select(
    "cycle_id", cy.profile_of(F.col("label_fleet"), F.col("label_org"), "fleet-default").alias("profile")))


def _stage(a, b):
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN round(greatest({b} - {a}, 0.0), 3) END"


def _iso(x):
    return f"strftime(make_timestamp(CAST(round({x} * 1000000) AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


register("derive_cycle_record", oracle_with(["fx_cycle_marks"], f"""
, {_M}
SELECT cycle_id, outcome, round(greatest(completed_at - spawned_at, 0.0), 3) AS total_secs,
  {_stage('sandbox_started_at', 'allocation_completed_at')} AS allocated_secs,
  {_stage('jit_started_at', 'jit_completed_at')} AS jit_mint_secs,
  {_stage('sandbox_started_at', 'sandbox_ready_at')} AS sandbox_create_secs,
  {_stage('sandbox_ready_at', 'runner_command_started_at')} AS runner_start_secs,
  {_stage('sandbox_started_at', 'runner_command_started_at')} AS launch_secs,
  CASE WHEN runner_command_started_at IS NOT NULL AND (outcome = 'idle' OR busy_at IS NOT NULL)
       THEN {_stage('runner_command_started_at', 'coalesce(busy_at, completed_at)')} END AS idle_secs,
  {_stage('busy_at', 'completed_at')} AS busy_secs,
  {_stage('completed_at', 'allocation_completed_at')} AS teardown_secs,
  CASE WHEN outcome = 'job' THEN busy_at IS NOT NULL END AS job_phase_observed,
  {_iso('spawned_at')} AS started_at, {_iso('completed_at')} AS completed_at, {_iso('busy_at')} AS busy_at
FROM m
"""))(lambda spark, sf: cy.derive_cycle_record(_marks(spark, sf), keep=["cycle_id"]))

_STATE_SQL = f"""
, ev AS (SELECT * FROM fx_cycle_events WHERE ts <= TIMESTAMP '{EVENTS_AS_OF}'),
f AS (SELECT cycle_id, min(ts) AS spawned_at, min(ts) FILTER (WHERE event = 'online') AS online_at,
             min(ts) FILTER (WHERE event = 'completed') AS completed_at, min(ts) FILTER (WHERE event = 'deleted') AS deleted_at
      FROM ev GROUP BY cycle_id),
b AS (SELECT e.cycle_id, min(e.ts) AS busy_at FROM ev e JOIN f ON f.cycle_id = e.cycle_id
      WHERE e.event = 'busy' AND e.ts > f.online_at GROUP BY e.cycle_id),
st AS (SELECT f.cycle_id, CASE WHEN deleted_at IS NOT NULL THEN 'REMOVED' WHEN completed_at IS NOT NULL THEN 'CLEANUP_PENDING'
              WHEN busy_at IS NOT NULL THEN 'BUSY' WHEN online_at IS NOT NULL THEN 'IDLE' ELSE 'SPAWNING' END AS state,
              spawned_at, online_at, busy_at FROM f LEFT JOIN b USING (cycle_id))
"""


def _states(spark, sf):
    return cy.cycle_state(fixture(spark, sf, "fx_cycle_events"), ts_lit(EVENTS_AS_OF))


register("cycle_state", oracle_with(["fx_cycle_events"], _STATE_SQL + "SELECT * FROM st"))(_states)


def _timers(spark, sf):
    states = cy.cycle_state(fixture(spark, sf, "fx_timer_events"), ts_lit(EVENTS_AS_OF))
    return cy.deadline_timers(states, ts_lit(EVENTS_AS_OF), IDLE_DEADLINE, JOB_MAX)


register("deadline_timers", oracle_with(["fx_timer_events"], _STATE_SQL.replace("fx_cycle_events", "fx_timer_events") + f"""
SELECT cycle_id, state, CASE WHEN state = 'IDLE' THEN 'idle_deadline' ELSE 'job_max_secs' END AS timer FROM st
WHERE (state = 'IDLE' AND epoch(TIMESTAMP '{EVENTS_AS_OF}') - epoch(spawned_at) > {IDLE_DEADLINE})
   OR (state = 'BUSY' AND epoch(TIMESTAMP '{EVENTS_AS_OF}') - epoch(busy_at) > {JOB_MAX})
"""))(_timers)

#: What the stream of timers reports: the deadlines missed before the last event, by the events up to them.
TIMER_ORACLE = oracle_with(["fx_timer_events"], f"""
, e AS (SELECT cycle_id, min(ts) AS spawned, min(ts) FILTER (event = 'online') AS online,
               min(ts) FILTER (event IN ('completed', 'deleted')) AS ended FROM fx_timer_events GROUP BY cycle_id),
b AS (SELECT t.cycle_id, min(t.ts) AS busy FROM fx_timer_events t JOIN e USING (cycle_id)
      WHERE t.event = 'busy' AND t.ts > e.online GROUP BY t.cycle_id),
d AS (SELECT cycle_id, busy, ended, greatest(spawned + INTERVAL {IDLE_DEADLINE} SECOND, online) AS idle_due,
             busy + INTERVAL {JOB_MAX} SECOND AS busy_due FROM e LEFT JOIN b USING (cycle_id) WHERE online IS NOT NULL),
f AS (SELECT *, (busy IS NULL OR busy > idle_due) AND (ended IS NULL OR ended > idle_due) AS idle FROM d),
w AS (SELECT max(ts) AS upto FROM fx_timer_events)
SELECT cycle_id, 'IDLE' AS state, 'idle_deadline' AS timer FROM f, w WHERE idle AND idle_due < upto
UNION ALL SELECT cycle_id, 'BUSY', 'job_max_secs' FROM f, w
WHERE NOT idle AND busy IS NOT NULL AND (ended IS NULL OR ended > busy_due) AND busy_due < upto
""")


def _firings(spark, sf):
    events = fixture(spark, sf, "fx_timer_events")
    last = events.agg(F.max("ts").alias("ts")).first()["ts"]
    return cy.deadline_firings(events, ts_lit(str(last)), IDLE_DEADLINE, JOB_MAX)


register("deadline_firings", TIMER_ORACLE)(_firings)

register("failure_runs", oracle_with(["fx_polls"], """
, isl AS (SELECT *, sum(CASE WHEN result = 'unreadable_idle' THEN 0 ELSE 1 END)
                  OVER (PARTITION BY cycle_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
          FROM fx_polls),
stk AS (SELECT *, row_number() OVER (PARTITION BY cycle_id, island ORDER BY ts, event_id) AS streak
        FROM isl WHERE result = 'unreadable_idle')
SELECT cycle_id, arg_min(event_id, ts) AS event_id, min(ts) AS verdict_at FROM stk WHERE streak = 3 GROUP BY cycle_id
"""))(lambda spark, sf: cy.failure_runs(fixture(spark, sf, "fx_polls")))

# ---------------------------------------------------------------- request log


def _responses(spark, sf):
    r = fixture(spark, sf, "fx_api_responses")
    d = ap.directed_delay(F.col("retry_after"), F.col("reset"), F.col("remaining"), ntz_epoch_secs("ts"))
    return r.withColumn("_d", d)


register("directed_delay", oracle_with(["fx_api_responses"], """
, x AS (SELECT *, epoch(ts) AS now_s,
          coalesce(TRY_CAST(trim(retry_after) AS DOUBLE),
                   epoch(try_strptime(trim(retry_after), '%a, %d %b %Y %H:%M:%S GMT')) - epoch(ts)) AS ra,
          TRY_CAST(trim(reset) AS DOUBLE) - epoch(ts) AS rs FROM fx_api_responses)
SELECT event_id,
  CASE WHEN retry_after IS NOT NULL AND ra IS NOT NULL AND isfinite(ra) AND ra >= 0 THEN ra
       WHEN reset IS NOT NULL AND trim(remaining) = '0' AND rs IS NOT NULL AND isfinite(rs) AND rs > 0 THEN rs END AS delay_secs,
  CASE WHEN retry_after IS NOT NULL AND ra IS NOT NULL AND isfinite(ra) AND ra >= 0 THEN 'retry-after'
       WHEN reset IS NOT NULL AND trim(remaining) = '0' AND rs IS NOT NULL AND isfinite(rs) AND rs > 0 THEN 'rate-limit-reset' END AS source
FROM x
"""))(lambda spark, sf: _responses(spark, sf).select("event_id", F.col("_d.delay_secs").alias("delay_secs"),
                                                     F.col("_d.source").alias("source")))


def _backoff(spark, sf):
    log = fixture(spark, sf, "fx_api_log")
    d = ap.directed_delay(F.col("retry_after"), F.lit(None).cast("string"), F.col("remaining"), ntz_epoch_secs("ts"))
    return ap.backoff_sequence(log, directed=d)


_BACKOFF_SQL = """
, a AS (SELECT *, status IN (403, 429) AS lim,
          retry_after IS NOT NULL AND TRY_CAST(trim(retry_after) AS DOUBLE) >= 0 AS dir FROM fx_api_log),
t AS (SELECT *, coalesce(sum(CAST(tick_completed AS INT)) OVER (PARTITION BY fleet ORDER BY ts, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tick FROM a),
r AS (SELECT *, tick_completed AND sum(CAST(lim AS INT)) OVER (PARTITION BY fleet, tick) = 0 AS rst FROM t),
s AS (SELECT *, coalesce(sum(CAST(rst AS INT)) OVER (PARTITION BY fleet ORDER BY ts, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM r),
k AS (SELECT *, sum(CAST(lim AND NOT dir AS INT)) OVER (PARTITION BY fleet, seg ORDER BY ts, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kk FROM s),
bo AS (SELECT event_id, ts, fleet, status,
         CASE WHEN NOT lim THEN NULL WHEN dir THEN TRY_CAST(trim(retry_after) AS DOUBLE)
              ELSE least(60.0 * pow(2.0, kk - 1), 900.0) END AS cooldown_secs,
         CASE WHEN NOT lim THEN NULL WHEN dir THEN 'retry-after' ELSE 'exponential-fallback' END AS cooldown_source,
         rst AS backoff_reset FROM k)
"""

register("backoff_sequence", oracle_with(["fx_api_log"], _BACKOFF_SQL + "SELECT * FROM bo"))(
    lambda spark, sf: _backoff(spark, sf).select("event_id", "ts", "fleet", "status", "cooldown_secs",
                                                 "cooldown_source", "backoff_reset"))

register("pacing_gaps", oracle_with(["fx_api_log"], _BACKOFF_SQL + f"""
, p AS (SELECT *, epoch(ts) AS st, CASE WHEN cooldown_secs IS NOT NULL THEN epoch(ts) + cooldown_secs END AS ce FROM bo),
q AS (SELECT event_id, fleet, st - lag(st) OVER w AS gap_secs,
        greatest(lag(st) OVER w + {SPACING}, max(ce) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS allowed_from, st
      FROM p WINDOW w AS (PARTITION BY fleet ORDER BY ts, event_id))
SELECT event_id, fleet, gap_secs, allowed_from, coalesce(st < allowed_from, false) AS early FROM q
"""))(lambda spark, sf: ap.pacing_gaps(_backoff(spark, sf), SPACING).select(
    "event_id", "fleet", "gap_secs", "allowed_from", "early"))


register("pacing_gate", oracle_with(["fx_api_log"], _BACKOFF_SQL + f"""
, p AS (SELECT *, epoch(ts) AS st, CASE WHEN cooldown_secs IS NOT NULL THEN epoch(ts) + cooldown_secs END AS ce,
               status NOT IN (403, 429) AS ok FROM bo),
sg AS (SELECT *, coalesce(sum(CAST(ok AS INT)) OVER (PARTITION BY fleet ORDER BY ts, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM p),
cm AS (SELECT *, max(ce) OVER (PARTITION BY fleet, seg ORDER BY ts, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cmax FROM sg),
gt AS (SELECT *, CASE WHEN ok THEN st + {SPACING} ELSE greatest(st + {SPACING}, coalesce(cmax, st + {SPACING})) END AS gate FROM cm),
q AS (SELECT event_id, fleet, st - lag(st) OVER w AS gap_secs, lag(gate) OVER w AS allowed_from, st
      FROM gt WINDOW w AS (PARTITION BY fleet ORDER BY ts, event_id))
SELECT event_id, fleet, gap_secs, allowed_from, coalesce(st < allowed_from, false) AS early FROM q
"""))(lambda spark, sf: ap.pacing_gate(_backoff(spark, sf), SPACING).select(
    "event_id", "fleet", "gap_secs", "allowed_from", "early"))
