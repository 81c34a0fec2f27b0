"""T-3 / T-5 on a stream: lifecycle fold per cycle with keyed state.

``applyInPandasWithState`` keeps, per cycle, the first time each event was
seen (and the first busy after going online); the state machine only moves
forward, so those times decide the state.  A removed cycle's state is kept
until the watermark passes its deletion, since events may come late by the
watermark's delay, and is dropped then.  A cycle that is never deleted is
forgotten ``forget_secs`` after its last event; an event that comes later
still starts it anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.core import EPOCH_NTZ

OUTPUT_SCHEMA = ("cycle_id long, state string, spawned_at timestamp_ntz, online_at timestamp_ntz, "
                 "busy_at timestamp_ntz")
STATE_SCHEMA = ("spawned_at timestamp_ntz, online_at timestamp_ntz, completed_at timestamp_ntz, "
                "deleted_at timestamp_ntz, busy_times array<timestamp_ntz>")


def _min(a, b):
    if a is None or pd.isna(a):
        return b
    if b is None or pd.isna(b):
        return a
    return min(a, b)


#: A cycle without any event for so long is forgotten.
FORGET_SECS = 45 * 86400


def forget_at(last, state: GroupState, forget_secs: int) -> int:
    """When a key that was last heard of at ``last`` is forgotten, in ms; never behind the watermark."""
    return max(int(pd.Timestamp(last).value // 1_000_000), state.getCurrentWatermarkMs()) + max(1, forget_secs * 1000)


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, forget_secs: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    spawned = online = completed = deleted = None
    busy_events: list = []
    last = None
    if state.exists:
        spawned, online, completed, deleted, kept = state.get
        busy_events = [t for t in (kept if kept is not None else []) if t is not None and not pd.isna(t)]
    for pdf in batches:
        spawned = _min(spawned, pdf["ts"].min())
        last = pdf["ts"].max() if last is None else max(last, pdf["ts"].max())
        for ev, col in (("online", "online"), ("completed", "completed"), ("deleted", "deleted")):
            sel = pdf.loc[pdf["event"] == ev, "ts"]
            if len(sel):
                if col == "online":
                    online = _min(online, sel.min())
                elif col == "completed":
                    completed = _min(completed, sel.min())
                else:
                    deleted = _min(deleted, sel.min())
        busy_events.extend(pdf.loc[pdf["event"] == "busy", "ts"].tolist())
    # busy counts only after the first online.  An earlier online may still
    # arrive in a later batch, so every busy time of the cycle is kept (a
    # cycle claims few jobs, so the list stays short).
    busy_events = sorted(set(busy_events))
    busy = None
    if online is not None:
        after = [t for t in busy_events if t > online]
        busy = min(after) if after else None
    if deleted is not None:
        st = "REMOVED"
    elif completed is not None:
        st = "CLEANUP_PENDING"
    elif busy is not None:
        st = "BUSY"
    elif online is not None:
        st = "IDLE"
    else:
        st = "SPAWNING"
    state.update((spawned, online, completed, deleted, busy_events))
    if st == "REMOVED":
        state.setTimeoutTimestamp(max(int(pd.Timestamp(deleted).value // 1_000_000), state.getCurrentWatermarkMs() + 1))
    else:
        state.setTimeoutTimestamp(forget_at(last, state, forget_secs))
    yield pd.DataFrame({"cycle_id": [key[0]], "state": [st], "spawned_at": [spawned], "online_at": [online],
                        "busy_at": [busy]})


def event_time(ts: str = "ts"):
    """A zone-less event time as the instant that watermarks need."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), F.col(ts)))


def cycle_state_stream(events: DataFrame, late: str = "7 days", forget_secs: int = FORGET_SECS) -> DataFrame:
    """Update-mode stream of (cycle_id, state, spawned_at, online_at, busy_at).

    ``late``: how late an event may come; rows later than that are dropped,
    and removed cycles are forgotten after that time; all others are
    ``forget_secs`` after their last event.
    """
    def fold(key, batches, state):
        yield from _fold(key, batches, state, forget_secs)

    return (events.select("cycle_id", "ts", "event", event_time().alias("_event_time"))
            .withWatermark("_event_time", late).groupBy("cycle_id")
            .applyInPandasWithState(fold, OUTPUT_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.EventTimeTimeout))
