"""T-4 on a stream: lifecycle deadline timers with event-time timeouts.

Each cycle folds its events (as in ``cycle_state``).  An IDLE cycle
is due at ``spawned + idle_deadline`` (once it is online), a BUSY one at
``busy_at + job_max``; it is reported, once, if it is still in that state
then, strictly later, like the reference's ``now - t > limit``.  Whether it
is, is decided by the events up to the due time, when the watermark has
passed it: the result depends on the events alone, not on how they are dealt
to micro-batches.

A call into Python costs far more than folding a cycle, so cycles are dealt
by hash to ``BUCKETS`` buckets and a bucket is a state: arrays with a row per
live cycle and per busy time.  A cycle keeps the time it wants to be woken at,
and a call looks only at cycles that have events or whose time has passed.

State goes away: behind the watermark once a cycle is deleted, and for any
other cycle ``forget`` after its last event; a bucket goes with its last
cycle.  An event that comes later still starts the cycle anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.core import EPOCH_NTZ

OUTPUT_SCHEMA = "cycle_id long, state string, timer string"
STATE_SCHEMA = "cycles binary, busy binary"
#: A cycle without any event for so long is forgotten.
FORGET_SECS = 45 * 86400
#: States that the cycles are dealt to; a state holds 64 bytes per live cycle and 16 per busy time.
BUCKETS = 1 << 12
#: Events of a bucket held before they are folded.
HELD = 1 << 16
#: Rows of the array of cycles, a column per cycle in order of id.
CYCLE, SPAWNED, ONLINE, COMPLETED, DELETED, LAST, FIRED, WAKE = range(8)
_KINDS = {"online": ONLINE, "completed": COMPLETED, "deleted": DELETED, "busy": -1}
#: Later than any time in ms.
NEVER = 1 << 62
_NO_TIME = -(1 << 63)


def _fold(live: np.ndarray, busy: np.ndarray, ids: np.ndarray, kinds: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``live`` and ``busy`` with the events; cycles that have some want to be woken at once."""
    merged = np.union1d(live[CYCLE], ids)
    old, at = np.searchsorted(merged, live[CYCLE]), np.searchsorted(merged, ids)
    out = np.full((8, len(merged)), NEVER, np.int64)
    out[CYCLE], out[LAST], out[FIRED] = merged, _NO_TIME, 0
    out[:, old] = live
    np.minimum.at(out[SPAWNED], at, times)
    np.maximum.at(out[LAST], at, times)
    out[WAKE, at] = _NO_TIME
    for row in (ONLINE, COMPLETED, DELETED):
        own = kinds == row
        np.minimum.at(out[row], at[own], times[own])
    own = kinds == _KINDS["busy"]
    busy = np.stack([np.concatenate([old[busy[0]], at[own]]), np.concatenate([busy[1], times[own]])])
    return out, np.unique(busy, axis=1)


def _first_after(live: np.ndarray, busy: np.ndarray) -> np.ndarray:
    """First busy time after going online (busy only promotes an IDLE cycle)."""
    first = np.full(live.shape[1], NEVER, np.int64)
    at, times = busy[:, busy[1] > live[ONLINE, busy[0]]]
    np.minimum.at(first, at, times)
    return first


def _due(live: np.ndarray, busy: np.ndarray, idle_ms: int, job_ms: int) -> tuple[np.ndarray, np.ndarray]:
    """When each cycle misses a deadline that it was not reported for, or ``NEVER``; whether that is the idle one."""
    busy_at, ended = _first_after(live, busy), np.minimum(live[COMPLETED], live[DELETED])
    idle = np.maximum(live[SPAWNED] + idle_ms, live[ONLINE])
    is_idle = (busy_at > idle) & (ended > idle)
    is_busy = (busy_at < NEVER) & (ended > busy_at + job_ms)
    due = np.where(is_idle, idle, np.where(is_busy, busy_at + job_ms, NEVER))
    return np.where(live[FIRED] == 1, NEVER, due), is_idle


def make_timer_fn(idle_deadline_secs: int, job_max_secs: int, forget_secs: int = FORGET_SECS):
    def fn(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live, busy = np.zeros((8, 0), np.int64), np.zeros((2, 0), np.int64)
        if state.exists:
            live, busy = (np.frombuffer(x, np.int64).reshape(n, -1) for n, x in zip((8, 2), state.get))
            live = live.copy()
        held, rows = [], 0
        for pdf in () if state.hasTimedOut else batches:
            held.append([pdf[c].to_numpy() for c in ("cycle", "kind", "t")])
            rows += len(pdf)
            if rows > max(HELD, live.shape[1]):
                live, busy = _fold(live, busy, *map(np.concatenate, zip(*held)))
                held, rows = [], 0
        if held:
            live, busy = _fold(live, busy, *map(np.concatenate, zip(*held)))
        now = state.getCurrentWatermarkMs()
        awake = live[WAKE] < now
        due, is_idle = _due(live, busy, idle_deadline_secs * 1000, job_max_secs * 1000)
        hit = awake & (due < now)
        if hit.any():
            ids = [None] * int(hit.sum()) if key[0] < 0 else live[CYCLE, hit]
            yield pd.DataFrame({"cycle_id": ids, "state": np.where(is_idle[hit], "IDLE", "BUSY").astype(object),
                                "timer": np.where(is_idle[hit], "idle_deadline", "job_max_secs").astype(object)})
        live[FIRED, hit] = 1
        due[hit] = NEVER
        ends = np.where(live[DELETED] < NEVER, live[DELETED], live[LAST] + forget_secs * 1000)
        live[WAKE, awake] = np.maximum(np.minimum(due, ends), now + 1)[awake]
        stay = ~(awake & (ends < now))
        if not stay.any():
            state.remove()
            return
        if not stay.all():
            busy = busy[:, stay[busy[0]]]
            busy = np.stack([(np.cumsum(stay) - 1)[busy[0]], busy[1]])
            live = live[:, stay]
        state.update((live.tobytes(), busy.tobytes()))
        state.setTimeoutTimestamp(max(int(live[WAKE].min()), now + 1))
    return fn


def _bucket(cycle: Column, buckets: int) -> Column:
    """The bucket of a cycle; the null cycle has -1 to itself."""
    return F.when(cycle.isNull(), -1).otherwise(F.pmod(F.xxhash64(cycle), F.lit(buckets))).cast("int")


def deadline_timer_stream(events: DataFrame, idle_deadline_secs: int, job_max_secs: int,
                          watermark: str = "0 seconds", forget_secs: int = FORGET_SECS, buckets: int = BUCKETS) -> DataFrame:
    """Append-mode stream of (cycle_id, state, timer) as timers fire.

    ``buckets`` is part of the state: a stream goes on with the number it began with.
    """
    cycle, micros = F.col("cycle_id").cast("long"), F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), F.col("ts"))
    millis = F.call_function("div", micros - F.pmod(micros, F.lit(1000)), F.lit(1000))
    kind = F.lit(0)
    for name, code in _KINDS.items():
        kind = F.when(F.col("event") == name, code).otherwise(kind)
    return (events.select(_bucket(cycle, buckets).alias("bucket"), F.coalesce(cycle, F.lit(0)).alias("cycle"),
                          F.coalesce(millis, F.lit(_NO_TIME)).alias("t"), kind.cast("tinyint").alias("kind"),
                          F.timestamp_micros(micros).alias("_event_time"))
            .withWatermark("_event_time", watermark).groupBy("bucket")
            .applyInPandasWithState(make_timer_fn(idle_deadline_secs, job_max_secs, forget_secs), OUTPUT_SCHEMA, STATE_SCHEMA,
                                    "append", GroupStateTimeout.EventTimeTimeout))
