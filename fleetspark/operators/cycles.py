"""Cycle records, outcomes and lifecycle state (P4-P9, T-3, T-4, W5).

Batch forms of the per-cycle thread logic: a cycle's facts are columns, so
each rule is one ``CASE``; the lifecycle fold is an aggregate per cycle
(the state machine is monotone, so first/last event times decide it); the
failure streak is gaps-and-islands over each cycle's polls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import iso_millis, stage_secs
from ..fixed import SESSION_READ_MAX_ERRS  # noqa: F401

STATES = ("SPAWNING", "IDLE", "BUSY", "CLEANUP_PENDING")


def profile_of(fleet_label: Column, org_label: Column, fleet_default: str = "", org_default: str = "") -> Column:
    """First non-empty of labels.fleet, labels.org, the fleet default,
    the org default, else 'unknown'."""
    cands = [F.nullif(fleet_label, F.lit("")), F.nullif(org_label, F.lit(""))]
    cands += [F.lit(x) for x in (fleet_default, org_default) if x]
    return F.coalesce(*cands, F.lit("unknown"))


def classify_outcome(ended_by: Column, busy_at: Column, exit_code: Column) -> Column:
    """(outcome, termination_reason) from how the cycle ended.

    ``ended_by`` is one of exception, session_unreadable, runner_exit,
    job_max, drain, quiesce, idle_deadline.
    """
    busy = busy_at.isNotNull()
    outcome = (F.when(ended_by == "session_unreadable", F.when(busy, "job").otherwise("unknown"))
               .when(ended_by == "runner_exit", F.when(busy | (exit_code == 0), "job").otherwise("failed"))
               .when(ended_by == "job_max", "job")
               .when(ended_by.isin("drain", "quiesce", "idle_deadline"), "idle")
               .otherwise("failed"))
    reason = (F.when(ended_by == "job_max", "job_max_secs")
              .when(ended_by.isin("session_unreadable", "runner_exit", "drain", "quiesce", "idle_deadline"), ended_by)
              .otherwise("cycle_failed"))
    return F.struct(outcome.alias("outcome"), reason.alias("termination_reason"))


def classify_cleanup(create_attempted: Column, sandbox_created: Column, delete_failed: Column,
                     jit_attempted: Column, runner_registered: Column) -> Column:
    """(cleanup_status, cleanup_complete)."""
    status = (F.when(sandbox_created, F.when(delete_failed, "delete_failed").otherwise("deleted"))
              .when(create_attempted, "create_unconfirmed").otherwise("create_not_attempted"))
    complete = (~(jit_attempted & ~runner_registered) & ~(create_attempted & ~sandbox_created)
                & (status != "delete_failed"))
    return F.struct(status.alias("cleanup_status"), complete.alias("cleanup_complete"))


def hold_eligible(sandbox_created: Column, hold_secs: int, outcome: Column, exit_code: Column) -> Column:
    """Keep a failed cycle's sandbox for debugging."""
    if hold_secs <= 0:
        return F.lit(False)
    return sandbox_created & ((outcome == "failed") | F.coalesce(exit_code != 0, F.lit(False)))


def derive_cycle_record(marks: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """P4+P5: stage durations and ISO timestamps from epoch marks.

    ``marks`` has spawned_at, jit_started_at, jit_completed_at,
    sandbox_started_at, sandbox_ready_at, runner_command_started_at,
    busy_at, completed_at, allocation_completed_at (epoch seconds) and
    ``outcome``.
    """
    keep = keep or []
    c = F.col
    idle_ok = c("runner_command_started_at").isNotNull() & ((c("outcome") == "idle") | c("busy_at").isNotNull())
    return marks.select(
        *keep, "outcome",
        F.round(F.greatest(c("completed_at") - c("spawned_at"), F.lit(0.0)), 3).alias("total_secs"),
        stage_secs("sandbox_started_at", "allocation_completed_at").alias("allocated_secs"),
        stage_secs("jit_started_at", "jit_completed_at").alias("jit_mint_secs"),
        stage_secs("sandbox_started_at", "sandbox_ready_at").alias("sandbox_create_secs"),
        stage_secs("sandbox_ready_at", "runner_command_started_at").alias("runner_start_secs"),
        stage_secs("sandbox_started_at", "runner_command_started_at").alias("launch_secs"),
        F.when(idle_ok, stage_secs(c("runner_command_started_at"), F.coalesce(c("busy_at"), c("completed_at"))))
        .alias("idle_secs"),
        stage_secs("busy_at", "completed_at").alias("busy_secs"),
        stage_secs("completed_at", "allocation_completed_at").alias("teardown_secs"),
        F.when(c("outcome") == "job", c("busy_at").isNotNull()).alias("job_phase_observed"),
        iso_millis("spawned_at").alias("started_at"),
        iso_millis("completed_at").alias("completed_at"),
        iso_millis("busy_at").alias("busy_at"),
    )


def cycle_state(events: DataFrame, as_of_col: Column | None = None) -> DataFrame:
    """T-3 (batch): lifecycle state per cycle from its events.

    Events: spawned, online (SPAWNING->IDLE), busy (IDLE->BUSY only),
    completed (->CLEANUP_PENDING), deleted (removed).  The machine only
    moves forward, so the fold equals: removed if any delete; else pending
    if completed; else BUSY if a busy event follows the first online; else
    IDLE if online; else SPAWNING.  One aggregate per cycle, combined
    map-side.
    """
    ev = events if as_of_col is None else events.filter(F.col("ts") <= as_of_col)
    first = ev.groupBy("cycle_id").agg(
        F.min("ts").alias("spawned_at"),
        F.min(F.when(F.col("event") == "online", F.col("ts"))).alias("online_at"),
        F.min(F.when(F.col("event") == "completed", F.col("ts"))).alias("completed_at"),
        F.min(F.when(F.col("event") == "deleted", F.col("ts"))).alias("deleted_at"))
    busy = (ev.filter(F.col("event") == "busy").select("cycle_id", F.col("ts").alias("bts"))
            .join(first.select("cycle_id", "online_at"), "cycle_id")
            .filter(F.col("bts") > F.col("online_at"))
            .groupBy("cycle_id").agg(F.min("bts").alias("busy_at")))
    j = first.join(busy, "cycle_id", "left")
    state = (F.when(F.col("deleted_at").isNotNull(), "REMOVED")
             .when(F.col("completed_at").isNotNull(), "CLEANUP_PENDING")
             .when(F.col("busy_at").isNotNull(), "BUSY")
             .when(F.col("online_at").isNotNull(), "IDLE").otherwise("SPAWNING"))
    return j.select("cycle_id", state.alias("state"), "spawned_at", "online_at", "busy_at")


def deadline_timers(states: DataFrame, as_of: Column, idle_deadline_secs: int, job_max_secs: int) -> DataFrame:
    """T-4 (batch): cycles whose timer has fired at ``as_of`` (strictly past):
    IDLE past ``spawned_at + idle_deadline``; BUSY past ``busy_at + job_max``."""
    from ..functions.core import secs_between
    idle_due = (F.col("state") == "IDLE") & (secs_between("spawned_at", as_of) > idle_deadline_secs)
    busy_due = (F.col("state") == "BUSY") & (secs_between("busy_at", as_of) > job_max_secs)
    return states.filter(idle_due | busy_due).select(
        "cycle_id", "state", F.when(idle_due, "idle_deadline").otherwise("job_max_secs").alias("timer"))


def deadline_firings(events: DataFrame, until: Column, idle_deadline_secs: int, job_max_secs: int) -> DataFrame:
    """T-4 (batch): cycles that missed a deadline before ``until``, as the stream of timers reports them.

    A cycle is judged by the events up to its due time: IDLE at
    ``spawned_at + idle_deadline`` (or when it comes online later), else BUSY
    at ``busy_at + job_max``; at most one row each.
    """
    states = cycle_state(events)
    ends = events.where(F.col("event").isin("completed", "deleted")).groupBy("cycle_id").agg(F.min("ts").alias("ended_at"))
    j = states.where("online_at is not null").join(ends, "cycle_id", "left")
    idle_due = F.greatest(F.col("spawned_at") + F.make_dt_interval(secs=F.lit(idle_deadline_secs)), "online_at")
    busy_due = F.col("busy_at") + F.make_dt_interval(secs=F.lit(job_max_secs))
    never = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    ended, busy = F.coalesce("ended_at", never), F.coalesce("busy_at", never)
    idle = (busy > idle_due) & (ended > idle_due)
    due = F.when(idle, idle_due).when(ended > busy_due, busy_due)
    return (j.withColumn("_idle", idle).withColumn("_due", due).where(F.col("_due") < until)
            .select("cycle_id", F.when(F.col("_idle"), "IDLE").otherwise("BUSY").alias("state"),
                    F.when(F.col("_idle"), "idle_deadline").otherwise("job_max_secs").alias("timer")))


def failure_runs(polls: DataFrame, limit: int = SESSION_READ_MAX_ERRS) -> DataFrame:
    """The poll at which a cycle reaches ``limit`` consecutive unreadable
    polls with the runner confirmed idle (any other poll resets the streak).

    Gaps-and-islands: a running count of resets numbers the islands, the
    row number inside an island counts the streak, and the first row equal
    to ``limit`` is the verdict.  Windows are partitioned by cycle.
    """
    order = Window.partitionBy("cycle_id").orderBy("ts", "event_id")
    is_err = F.col("result") == "unreadable_idle"
    islands = polls.withColumn("_island", F.sum(F.when(is_err, 0).otherwise(1)).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    streak = islands.filter(is_err).withColumn(
        "_streak", F.row_number().over(Window.partitionBy("cycle_id", "_island").orderBy("ts", "event_id")))
    hits = streak.filter(F.col("_streak") == limit)
    return hits.groupBy("cycle_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"),
                                        F.min("ts").alias("verdict_at"))
