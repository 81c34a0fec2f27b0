"""End-to-end plan entry points and the text journal source/sink."""

from pyspark.sql import functions as F

from fleetspark.operators.topk import joined_top
from fleetspark.plans.reconcile import reconcile_org
from fleetspark.plans.usage import usage_report_from_journal
from fleetspark.session import scratch_path
from fleetspark.sources.journal import read_journal, write_cycle_records


def test_journal_text_round_trip_and_usage_plan(spark):
    recs = spark.createDataFrame(
        [("c1", "snap-a", "job", "deleted", 60.0, 60.0), ("c2", "snap-a", "idle", "deleted", 180.0, 180.0)],
        "cycle_id string, snapshot string, outcome string, cleanup_status string, total_secs double, allocated_secs double",
    ).select(F.lit("runner_cycle_complete").alias("event"), F.lit(1).alias("schema_version"), "*",
             F.struct(F.lit(2.0).alias("cpu"), F.lit(4.0).alias("memory_gib"), F.lit(10.0).alias("disk_gib"))
             .alias("declared_resources"))
    path = scratch_path(spark, "journal-test")
    write_cycle_records(recs, path)
    journal = read_journal(spark, path).withColumn("instance", F.lit("fleet-a"))
    inst = spark.createDataFrame([("fleet-a", "runner.service")], "instance string, unit string")
    rows = usage_report_from_journal(inst, journal, checkpoint=True).orderBy("line_no").collect()
    assert rows[0].text.startswith("fleet-a: structured completions=2; runner-up lines=0")
    assert rows[1].text == ("  snap-a: n=2 job=1 idle=1 failed=0 unknown=0 avg=2.00m p95=3.00m; "
                            "allocated=0.13 CPU-h/0.27 GiB-h RAM/0.67 GiB-h disk")


def test_reconcile_org_plan(spark):
    cls = spark.createDataFrame([(0, "default", ["self-hosted", "pool"], 2, 5)],
                                "class_pos int, name string, labels array<string>, min_idle int, max_live int")
    jobs = spark.createDataFrame([(i, i, "r", "queued", ["self-hosted", "pool"]) for i in range(4)],
                                 "job_id int, run_id int, repository string, status string, labels array<string>")
    runs = spark.createDataFrame([("r", i, "queued") for i in range(4)], "repository string, run_id int, status string")
    reg = spark.createDataFrame([(1, "default", "IDLE", None, 10), (2, "default", "BUSY", None, 11)],
                                "cycle_id long, cls_name string, state string, repository string, runner_id long")
    runners = spark.createDataFrame([(10, None, False), (11, None, True)], "runner_id long, repository string, busy boolean")
    plan, slots = reconcile_org(runs, jobs, cls, reg, runners, 1800, 300)
    p = plan.collect()[0]
    # queued 4, supply 1 (idle, not busy), live 2, floor 2, cap 5 -> min(max(3, 1, 0), 3) = 3
    assert (p.queued, p.supply, p.live, p.to_spawn, p.floor_slots) == (4, 1, 2, 3, 1)
    assert [r.idle_deadline_secs for r in slots.orderBy("slot").collect()] == [1800, 300, 300]


def test_keyed_top_k(spark):
    rows = [("a", f"n{i:03d}") for i in range(50)] + [("b", "z"), ("b", "y")]
    df = spark.createDataFrame(rows, "g string, name string")
    got = {r.g: r.names for r in joined_top(df, ["g"], "name", 3).collect()}
    assert got == {"a": "n000, n001, n002", "b": "y, z"}
