"""Streaming operators against their batch forms on small inputs."""

from pyspark.sql import functions as F

from fleetspark.functions.core import ts_lit
from fleetspark.operators import cycles as cy
from fleetspark.session import scratch_path
from fleetspark.streaming.runner import read_all, run_to_table
from fleetspark.streaming.timers import OUTPUT_SCHEMA, deadline_timer_stream

SCHEMA = "cycle_id long, ts timestamp_ntz, event string"


def test_deadline_timers_fire_like_batch(spark):
    src = scratch_path(spark, "timer-src")
    first = [(1, "2024-01-01 00:00:00", "spawned"), (1, "2024-01-01 00:01:00", "online"),
             (2, "2024-01-01 00:00:00", "spawned"), (2, "2024-01-01 00:01:00", "online"),
             (2, "2024-01-01 00:02:00", "busy"),
             (3, "2024-01-01 00:00:00", "spawned"), (3, "2024-01-01 00:05:00", "completed")]
    later = [(9, "2024-01-01 03:00:00", "spawned")]  # advances the watermark
    for i, rows in enumerate((first, later)):
        spark.createDataFrame(rows, "cycle_id long, ts string, event string") \
            .withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{src}/part{i}")
    stream = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    out = run_to_table(deadline_timer_stream(stream, idle_deadline_secs=3600, job_max_secs=4 * 3600), "append", "timers")
    got = {(r.cycle_id, r.timer) for r in read_all(spark, out, OUTPUT_SCHEMA).collect()}
    batch_events = spark.createDataFrame(first + later, "cycle_id long, ts string, event string") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    states = cy.cycle_state(batch_events)
    want = {(r.cycle_id, r.timer) for r in
            cy.deadline_timers(states, ts_lit("2024-01-01 03:00:00"), 3600, 4 * 3600).collect()}
    assert got == want == {(1, "idle_deadline")}


def test_cycle_state_stream_out_of_order_batches(spark):
    from fleetspark.streaming.cycle_state import OUTPUT_SCHEMA as CS_SCHEMA
    from fleetspark.streaming.cycle_state import cycle_state_stream
    from fleetspark.streaming.runner import read_latest
    src = scratch_path(spark, "cs-src")
    # busy events arrive before the online that precedes them
    batches = [[(1, "2024-01-01 00:00:02", "busy"), (1, "2024-01-01 00:00:05", "busy"),
                (2, "2024-01-01 00:00:00", "spawned")],
               [(1, "2024-01-01 00:00:03", "online"), (2, "2024-01-01 00:00:04", "busy")],
               [(2, "2024-01-01 00:00:01", "online"), (3, "2024-01-01 00:00:09", "completed")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "cycle_id long, ts string, event string") \
            .withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{src}/part{i}")
    stream = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    out = run_to_table(cycle_state_stream(stream), "update", "cs-test")
    got = {r.cycle_id: (r.state, r.busy_at) for r in read_latest(spark, out, CS_SCHEMA, ["cycle_id"]).collect()}
    all_rows = [r for b in batches for r in b]
    batch = cy.cycle_state(spark.createDataFrame(all_rows, "cycle_id long, ts string, event string")
                           .withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    want = {r.cycle_id: (r.state, r.busy_at) for r in batch.collect()}
    assert got == want
    assert got[1][0] == "BUSY" and got[2][0] == "BUSY" and got[3][0] == "CLEANUP_PENDING"


def test_failure_streak_carries_across_batches(spark):
    from fleetspark.streaming.failure_streak import OUTPUT_SCHEMA as FS_SCHEMA
    from fleetspark.streaming.failure_streak import failure_streak_stream
    src = scratch_path(spark, "fs-src")
    batches = [[(1, 1, "2024-01-01 00:00:01", "unreadable_idle"), (1, 2, "2024-01-01 00:00:02", "unreadable_idle"),
                (2, 3, "2024-01-01 00:00:01", "unreadable_idle"), (2, 4, "2024-01-01 00:00:02", "ok")],
               [(1, 5, "2024-01-01 00:00:03", "unreadable_idle"), (2, 6, "2024-01-01 00:00:03", "unreadable_idle"),
                (1, 7, "2024-01-01 00:00:04", "unreadable_idle")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "cycle_id long, event_id long, ts string, result string") \
            .withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{src}/part{i}")
    stream = (spark.readStream.schema("cycle_id long, event_id long, ts timestamp_ntz, result string")
              .option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src))
    out = run_to_table(failure_streak_stream(stream), "append", "fs-test")
    got = {(r.cycle_id, r.event_id) for r in read_all(spark, out, FS_SCHEMA).collect()}
    batch = spark.createDataFrame([r for b in batches for r in b], "cycle_id long, event_id long, ts string, result string") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = {(r.cycle_id, r.event_id) for r in cy.failure_runs(batch).collect()}
    assert got == want == {(1, 5)}


US_SCHEMA = "snapshot string, outcome string, cleanup_status string, total_secs double, completed_at timestamp_ntz"


def _records(spark, rows):
    return spark.createDataFrame(rows, US_SCHEMA.replace("timestamp_ntz", "string")).withColumn(
        "completed_at", F.col("completed_at").cast("timestamp_ntz"))


def _usage(spark, src, base):
    from fleetspark.streaming.usage import usage_report_stream
    stream = spark.readStream.schema(US_SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    return {tuple(r) for r in usage_report_stream(stream, 86400, base).collect()}


def test_usage_stream_goes_on_and_reads_touched_windows_only(spark, monkeypatch):
    from fleetspark.operators import telemetry as tm
    from fleetspark.sources.state import subfolders
    from fleetspark.streaming.usage import FactTable, windowed_records
    src, base = scratch_path(spark, "us-src"), scratch_path(spark, "us-base")
    first = [[("a", "job", "deleted", 60.0, "2024-01-01 10:00:00"), ("a", "idle", "deleted", 120.0, "2024-01-01 11:00:00"),
              ("", "job", "deleted", 5.0, "2024-01-01 11:00:00")],
             [("a", "job", "deleted", 30.0, "2024-01-02 10:00:00"), ("b", "failed", "deleted", None, "2024-01-01 12:00:00")]]
    later = [[("a", "odd", "create_not_attempted", 90.0, "2024-01-02 11:00:00"), ("a", "job", "deleted", 30.0, "2024-01-02 10:00:00")]]

    def want(batches):
        rows = _records(spark, [r for b in batches for r in b])
        return {tuple(r) for r in tm.usage_summary(windowed_records(rows, 86400), ["window_start"]).collect()}

    for i, rows in enumerate(first):
        _records(spark, rows).coalesce(1).write.parquet(f"{src}/part{i}")
    assert _usage(spark, src, base) == want(first)
    opened = []
    read = FactTable.read
    monkeypatch.setattr(FactTable, "read", lambda self, versions: opened.append(dict(versions)) or read(self, versions))
    for i, rows in enumerate(later):
        _records(spark, rows).coalesce(1).write.parquet(f"{src}/later{i}")
    assert _usage(spark, src, base) == want(first + later)
    day2 = 1704153600
    assert [sorted(v) for v in opened] == [[day2], [day2 - 86400, day2]]  # the merge opens one window, the report all
    kept = {(n, w) for n in subfolders(spark, f"{base}/facts") for w in subfolders(spark, f"{base}/facts/{n}")}
    assert len(kept) == 3 and len(subfolders(spark, f"{base}/index")) == 2  # two windows, and the version before of one


def test_replayed_batch_adds_nothing_twice(spark):
    from fleetspark.streaming.usage import FactTable, windowed_records
    table = FactTable(spark, scratch_path(spark, "us-base"))
    one, two = (windowed_records(_records(spark, [("a", "job", "deleted", v, "2024-01-01 10:00:00")]), 86400) for v in (10.0, 20.0))
    table.add(one, 0)
    table.add(two, 1)
    before = sorted(map(tuple, table.read(table.versions()).collect()), key=str)
    table.add(two, 1)
    assert sorted(map(tuple, table.read(table.versions()).collect()), key=str) == before and len(before) == 3
