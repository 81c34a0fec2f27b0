"""T-5: failure streak per cycle on a stream of session polls.

Keyed state holds the current run of unreadable-and-idle polls; any other
poll resets it.  The verdict row is emitted once, when the run reaches the
limit, and the key is then marked done and forgotten once the watermark
passes the verdict.  A cycle that never reaches the limit is forgotten
``forget_secs`` after its last poll.  Polls of one cycle are processed
in (ts, event_id) order within a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.cycles import SESSION_READ_MAX_ERRS
from .cycle_state import FORGET_SECS, event_time, forget_at

OUTPUT_SCHEMA = "cycle_id long, event_id long, verdict_at timestamp_ntz"
STATE_SCHEMA = "streak long, done boolean"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, forget_secs: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    streak, done = state.get if state.exists else (0, False)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    hit = None
    if not done:
        for ev, ts, res in zip(rows["event_id"], rows["ts"], rows["result"]):
            streak = streak + 1 if res == "unreadable_idle" else 0
            if streak == SESSION_READ_MAX_ERRS:
                hit = (ev, ts)
                done = True
                break
    state.update((int(streak), bool(done)))
    if done:
        last = int(pd.Timestamp(rows["ts"].max()).value // 1_000_000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
    else:
        state.setTimeoutTimestamp(forget_at(rows["ts"].max(), state, forget_secs))
    if hit is not None:
        yield pd.DataFrame({"cycle_id": [key[0]], "event_id": [hit[0]], "verdict_at": [hit[1]]})


def failure_streak_stream(polls: DataFrame, late: str = "7 days", forget_secs: int = FORGET_SECS) -> DataFrame:
    """Append-mode stream of verdicts; ``late`` and ``forget_secs`` as in ``cycle_state_stream``."""
    def step(key, batches, state):
        yield from _step(key, batches, state, forget_secs)

    return (polls.select("cycle_id", "event_id", "ts", "result", event_time().alias("_event_time"))
            .withWatermark("_event_time", late).groupBy("cycle_id")
            .applyInPandasWithState(step, OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout))
