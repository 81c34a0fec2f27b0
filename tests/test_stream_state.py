"""State of the keyed streams goes away; what they report does not depend on micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from fleetspark.functions.core import ts_lit
from fleetspark.operators import cycles as cy
from fleetspark.session import scratch_path
from fleetspark.streaming.cycle_state import cycle_state_stream
from fleetspark.streaming.failure_streak import failure_streak_stream
from fleetspark.streaming.timers import deadline_timer_stream

EVENTS = "cycle_id long, ts timestamp_ntz, event string"
POLLS = "cycle_id long, event_id long, ts timestamp_ntz, result string"


def _write(spark, batches, schema):
    """One file, hence one micro-batch, per list of rows."""
    src = scratch_path(spark, "state-src")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema.replace("timestamp_ntz", "string")).withColumn("ts", F.col("ts").cast("timestamp_ntz")) \
            .coalesce(1).write.parquet(f"{src}/part{i:02d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)


def _drain(stream, mode):
    """Rows emitted, and the rows of state after each micro-batch."""
    spark, out = stream.sparkSession, []
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", scratch_path(spark, "state-ckpt"))
         .foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).trigger(availableNow=True).start())
    q.awaitTermination()
    return out, [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]


def _at(hours):
    return f"2024-01-{1 + int(hours // 24):02d} {int(hours % 24):02d}:{int(hours * 60 % 60):02d}:00"


def test_cycles_without_an_end_are_forgotten(spark):
    live = [(i, _at(0), "spawned") for i in range(40)] + [(i, _at(1), "online") for i in range(20)]
    stream = cycle_state_stream(_write(spark, [live, [(999, _at(100), "deleted")], [(998, _at(300), "deleted")]], EVENTS),
                                late="1 hour", forget_secs=24 * 3600)
    out, state = _drain(stream, "update")
    assert {r[0] for r in out} == {*range(40), 998, 999}
    assert max(state) >= 40 and state[-1] <= 1  # the last deletion itself is not behind the watermark


def test_polls_without_a_verdict_are_forgotten(spark):
    polls = [(i, i, _at(0), "unreadable_idle") for i in range(30)] + [(i, 100 + i, _at(1), "ok") for i in range(15)]
    late = [[(999, 1000, _at(100), "ok")], [(998, 1001, _at(300), "ok")]]
    out, state = _drain(failure_streak_stream(_write(spark, [polls, *late], POLLS), late="1 hour", forget_secs=24 * 3600), "append")
    assert out == [] and max(state) >= 30 and state[-1] == 1


def test_timer_state_is_dropped(spark):
    first = [(i, _at(0), "spawned") for i in range(30)] + [(i, _at(0.5), "online") for i in range(30)]
    ends = [(i, _at(0.75), "deleted") for i in range(10)] + [(i, _at(0.75), "busy") for i in range(10, 20)]
    later = [[(999, _at(200), "spawned"), (999, _at(200), "deleted")], [(998, _at(300), "spawned")], [(997, _at(500), "deleted")]]
    stream = deadline_timer_stream(_write(spark, [first, ends, *later], EVENTS), 3600, 4 * 3600, forget_secs=48 * 3600)
    out, state = _drain(stream, "append")
    assert sorted(out) == sorted([(i, "BUSY", "job_max_secs") for i in range(10, 20)] + [(i, "IDLE", "idle_deadline") for i in range(20, 30)])
    assert max(state) >= 30 and state[-1] <= 1


@pytest.mark.parametrize("files", [1, 2, 5])
def test_timers_do_not_depend_on_batches(spark, files):
    rng = random.Random(3)
    rows = []
    for cycle in range(60):
        at = rng.uniform(0, 60)
        rows.append((cycle, _at(at), "spawned"))
        for event in rng.sample(["online", "busy", "completed", "deleted"], rng.randint(0, 3)) + ["online"] * rng.randint(0, 1):
            rows.append((cycle, _at(at + rng.uniform(0.1, 9)), event))
    rows.append((999, _at(400), "spawned"))
    rows.sort(key=lambda r: r[1])
    size = -(-len(rows) // files)
    batches = [rows[i:i + size] for i in range(0, len(rows), size)]
    got, _ = _drain(deadline_timer_stream(_write(spark, batches, EVENTS), 5 * 3600, 2 * 3600, watermark="20 hours"), "append")
    events = spark.createDataFrame(rows, EVENTS.replace("timestamp_ntz", "string")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = cy.deadline_firings(events, ts_lit(_at(380)), 5 * 3600, 2 * 3600).collect()
    assert sorted(got) == sorted(map(tuple, want)) and len({r[2] for r in got}) == 2


def test_timers_share_states(spark):
    """Cycles of a bucket share one state and one call; null cycles, null events and null times go on as before."""
    rng = random.Random(4)
    rows = []
    for cycle in [None, -5, 2**60, *range(400)]:
        at = rng.uniform(0, 60)
        rows += [(cycle, _at(at), None), (cycle, _at(at + rng.uniform(0, 1)), "online")]
        rows += [(cycle, _at(at + rng.uniform(0.1, 9)), rng.choice(["busy", "busy", "completed", "deleted"])) for _ in range(rng.randint(0, 3))]
    rows += [(7777, _at(70), "busy"), (7777, None, "busy"), (7777, _at(70), "online"), (999, _at(400), "spawned")]
    batches = [[r for r in rows if r[1] is None or r[1] < _at(25)], [r for r in rows if r[1] is not None and r[1] >= _at(25)]]
    got, state = _drain(deadline_timer_stream(_write(spark, batches, EVENTS), 5 * 3600, 2 * 3600, watermark="9 hours", buckets=8), "append")
    events = spark.createDataFrame(rows, EVENTS.replace("timestamp_ntz", "string")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = cy.deadline_firings(events.where("cycle_id is not null and cycle_id <> 7777"), ts_lit(_at(380)), 5 * 3600, 2 * 3600).collect()
    assert max(state) <= 9  # one of them is the null cycle's
    by_id = sorted(r for r in got if r[0] is not None and r[0] != 7777)
    assert by_id == sorted(map(tuple, want)) and len({r[2] for r in by_id}) == 2
    alone = [(1, ts, event) for cycle, ts, event in rows if cycle is None]
    null = spark.createDataFrame(alone, EVENTS.replace("timestamp_ntz", "string")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert [r[1:] for r in got if r[0] is None] == [tuple(r)[1:] for r in cy.deadline_firings(null, ts_lit(_at(380)), 5 * 3600, 2 * 3600).collect()]
    assert [r for r in got if r[0] == 7777] == [(7777, "IDLE", "idle_deadline")]
