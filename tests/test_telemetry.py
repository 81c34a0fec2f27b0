"""Journal parsing and usage reports (S2, A1-A8) on own records."""

import json
import math
import random

from pyspark.sql import functions as F

from fleetspark.operators import telemetry as tm
from fleetspark.sources.journal import TELEMETRY_PREFIX, cycle_record_lines, parse_cycle_telemetry, scan_journal

def lines_df(spark, lines, instance="example-fleet"):
    return spark.createDataFrame([(instance, i, l) for i, l in enumerate(lines)], "instance string, n int, line string")


def cycle(**fields):
    return json.dumps({"event": "runner_cycle_complete", "schema_version": 1} | fields)


def test_only_valid_lines_are_parsed(spark):
    lines = [cycle(snapshot="a"), f"{TELEMETRY_PREFIX}{cycle(snapshot='a')}", f"text before {TELEMETRY_PREFIX}{cycle(snapshot='b')}",
             f"{TELEMETRY_PREFIX}{{", f"{TELEMETRY_PREFIX}{cycle(snapshot='c').replace('1', '3')}"]
    parsed = parse_cycle_telemetry(lines_df(spark, lines), keep=["n"])
    assert sorted((r.n, r.snapshot) for r in parsed.collect()) == [(1, "a"), (2, "b")]


def test_report_counts_completions_and_starts(spark):
    """Three starts, two structured completions, one of them without a usable allocation."""
    job = cycle(snapshot="img", outcome="job", total_secs=90, allocated_secs=90, cleanup_status="deleted",
                declared_resources={"cpu": 1, "memory_gib": 1, "disk_gib": 1})
    failed = cycle(snapshot="img", outcome="failed", total_secs=30, cleanup_status="deleted")
    started = [f"[{c}] runner up: sandbox={i}" for i, c in enumerate(("small", "small", "big"))]
    journal = lines_df(spark, [*started, TELEMETRY_PREFIX + job, TELEMETRY_PREFIX + failed], "east")
    inst = spark.createDataFrame([("east", "east.service")], "instance string, unit string")
    rows = tm.usage_report(inst, parse_cycle_telemetry(journal, keep=["instance"], keep_all=True)).collect()
    text = " ".join(r.text for r in rows)
    assert "structured completions=2; runner-up lines=3" in text and "allocation unavailable (coverage=1/2)" in text


def test_instances_without_structured_lines(spark):
    journal = lines_df(spark, ["[big] runner up: 1", "[small] runner up: 2", "[big] runner up: 3", "hello"], "west")
    journal = journal.unionByName(lines_df(spark, ["hello"], "north"))
    inst = spark.createDataFrame([("west", "w", 0), ("north", "n", 0), ("off", "", 0), ("broken", "b", 4)],
                                 "instance string, unit string, journal_exit int")
    rows = tm.usage_report(inst, parse_cycle_telemetry(journal, keep=["instance"], keep_all=True)).collect()
    assert {r.instance: r.text for r in rows} == {
        "west": "west: legacy window; 2 big, 1 small", "north": "north: legacy window; no spawns",
        "broken": "broken: journal unavailable (exit 4)"}


def test_strict_json(spark):
    good = '{"event":"runner_cycle_complete","schema_version":1,"snapshot":"s"}'
    bad = [good + " trailing", good[:-1], '["x"]', '{"event":"runner_cycle_complete","schema_version":"1"}',
           good + ', "b": 2']
    ok_float = good.replace('"schema_version":1', '"schema_version":1.0')
    df = lines_df(spark, [TELEMETRY_PREFIX + x for x in [good, ok_float] + bad])
    assert sorted(r.n for r in parse_cycle_telemetry(df, keep=["n"]).collect()) == [0, 1]


def test_nearest_rank_matches_definition(spark):
    rnd = random.Random(7)
    rows = []
    for g in range(40):
        n = rnd.randint(1, 60)
        rows += [(g, float(rnd.randint(0, 500))) for _ in range(n)]
    df = spark.createDataFrame(rows, "g int, x double")
    for p in (0.07, 0.5, 0.9, 0.95, 0.99):
        table = {r.g: r.x_p for r in tm.nearest_rank_table(df, ["g"], ["x"], p).collect()}
        for g in range(40):
            xs = sorted(x for gg, x in rows if gg == g)
            assert table[g] == xs[max(0, math.ceil(p * len(xs)) - 1)], (g, p)


def test_scan_window_and_record_round_trip(spark):
    df = spark.createDataFrame([(1, "2024-01-30 00:00:00"), (2, "2024-01-20 00:00:00")], "n int, ts string") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert [r.n for r in scan_journal(df, "2024-01-31 00:00:00", 3 * 86400).collect()] == [1]
    rec = spark.createDataFrame([("c1", "snap", 12.5, None)], "cycle_id string, snapshot string, total_secs double, busy_at string") \
        .select(F.lit("runner_cycle_complete").alias("event"), F.lit(1).alias("schema_version"), "*")
    line = cycle_record_lines(rec).collect()[0].line
    assert line == TELEMETRY_PREFIX + ('{"busy_at":null,"cycle_id":"c1","event":"runner_cycle_complete",'
                                       '"schema_version":1,"snapshot":"snap","total_secs":12.5}')
    back = parse_cycle_telemetry(cycle_record_lines(rec)).collect()[0]
    assert back.cycle_id == "c1" and back.total_secs == 12.5


def test_non_string_snapshot_is_not_grouped(spark):
    recs = [{"event": "runner_cycle_complete", "schema_version": 1, "snapshot": 5, "outcome": "job", "total_secs": 1},
            {"event": "runner_cycle_complete", "schema_version": 1, "snapshot": "", "outcome": "job", "total_secs": 1},
            {"event": "runner_cycle_complete", "schema_version": 1, "snapshot": "s", "outcome": 7, "total_secs": 1}]
    parsed = parse_cycle_telemetry(lines_df(spark, [TELEMETRY_PREFIX + json.dumps(r) for r in recs]))
    assert parsed.count() == 3
    rows = tm.usage_by_snapshot(parsed).collect()
    assert [(r.snapshot, r.n, r.unknown) for r in rows] == [("s", 1, 1)]


def test_facts_merge_to_the_summary_of_all_records(spark):
    from fleetspark.operators import telemetry as tm
    import random
    rng = random.Random(9)
    rows = [(rng.choice(["i", None]), rng.choice(["s1", "s2", "", None]), rng.choice(["job", "idle", "failed", "?"]),
             rng.choice(["deleted", "create_not_attempted", "failed"]), rng.choice([None, -1.0, round(rng.expovariate(0.01), 3)]),
             rng.choice([5.0, None]), 2.0, 4.0, 8.0, rng.choice([None, 1.25, 3.0])) for _ in range(400)]
    rows += [("full", "s", "job", "deleted", float(i), 3.0, 1.0, 1.0, 1.0, 0.5 * i) for i in range(50)]
    df = spark.createDataFrame(rows, "instance string, snapshot string, outcome string, cleanup_status string, total_secs double, "
                                     "allocated_secs double, cpu double, memory_gib double, disk_gib double, launch_secs double")
    halves = [tm.usage_facts(df.where(f"pmod(xxhash64(total_secs, snapshot), 2) = {k}"), ["instance"]) for k in (0, 1)]
    merged = tm.merge_facts(halves[0].unionByName(halves[1]), ["instance"])
    got = {tuple(r) for r in tm.summary_from_facts(merged, ["instance"]).collect()}
    assert got == {tuple(r) for r in tm.usage_summary(df, ["instance"]).collect()} and len(got) >= 4


def test_journal_is_aggregated_in_one_pass(spark):
    from fleetspark.operators import telemetry as tm
    from fleetspark.sources.journal import parse_cycle_telemetry
    journal = spark.createDataFrame([("i", "x"), ("i", "[c] runner up: y")], "instance string, line string")
    parsed = parse_cycle_telemetry(journal, "line", keep=["instance"], keep_all=True)
    plan = tm.journal_facts(parsed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("ExistingRDD") <= 2
