"""S7 report writer and S9 alert-state snapshots round-trip."""

import json

from pyspark.sql import functions as F

from fleetspark.operators import alerts as al
from fleetspark.session import scratch_path
from fleetspark.sources.report import write_audit_report
from fleetspark.sources.state import load_alert_state, save_alert_state


def test_report_sections_sorted_keys(spark):
    df = spark.createDataFrame([("b", 2, None)], "zeta string, alpha int, mid string")
    paths = write_audit_report({"summary": df}, scratch_path(spark, "report-test"))
    line = spark.read.text(paths["summary"]).collect()[0].value
    assert list(json.loads(line)) == ["alpha", "mid", "zeta"]


def test_alert_state_cycle(spark):
    base = scratch_path(spark, "state-test")
    empty = load_alert_state(spark, base, 0)
    assert empty.count() == 0
    findings = spark.createDataFrame([("a", "A"), ("b", "B")], "key string, text string")
    t1 = al.alert_transitions(findings, empty, 10_000.0, 3600)
    assert {r.key: r.status for r in t1.collect()} == {"a": "fresh", "b": "fresh"}
    save_alert_state(al.next_state(t1), base, 1)
    findings2 = spark.createDataFrame([("a", "A")], "key string, text string")
    t2 = al.alert_transitions(findings2, load_alert_state(spark, base, 1), 10_100.0, 3600)
    assert {r.key: r.status for r in t2.collect()} == {"a": "suppressed", "b": "recovered"}
    msg = al.alert_message(t1).collect()
    assert msg[0].findings == 2 and msg[0].body == "A\nB"
    assert al.alert_message(t2).count() == 0
    rec = al.recovered_message(t2).collect()
    assert rec[0].recovered == 1 and rec[0].body == "b"


def test_health_check_passes(spark):
    from fleetspark.plans.health_check import health_check
    base = scratch_path(spark, "hc-test")
    f1 = spark.createDataFrame([("i", "stuck", "1", "job 1 queued 5m"), ("i", "cap", "", "too many")],
                               "instance string, check string, entity string, text string")
    t1, m1 = health_check([f1], base, 1, 1.7e9, 3600)
    assert {r.status for r in t1.collect()} == {"fresh"} and m1.count() == 1
    f2 = spark.createDataFrame([("i", "stuck", "1", "job 1 queued 6m")], "instance string, check string, entity string, text string")
    t2, m2 = health_check([f2], base, 2, 1.7e9 + 60, 3600)
    assert {r.key: r.status for r in t2.collect()} == {"i|stuck|1": "suppressed", "i|cap|": "recovered"}
    assert m2.count() == 0


def test_alert_stream_split_and_empty_passes(spark):
    """Pass 1 comes in two files, pass 2 in one, pass 3 found nothing."""
    from fleetspark.streaming.alerts import alert_stream
    src = scratch_path(spark, "alert-src")
    schema = "pass_id long, now_epoch double, key string, text string"
    t = 1.7e9
    files = [[(1, t, "a", "A")], [(1, t, "b", "B"), (1, t, None, None)],
             [(2, t + 60, "a", "A"), (2, t + 60, None, None)], [(3, t + 120, None, None)]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/part{i}")
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    out, state = scratch_path(spark, "alert-out"), scratch_path(spark, "alert-state")
    alert_stream(stream, 3600, state, out).awaitTermination()
    got = {(r.pass_id, r.key): r.status for r in spark.read.parquet(out).collect()}
    assert got == {(1, "a"): "fresh", (1, "b"): "fresh", (2, "a"): "suppressed", (2, "b"): "recovered", (3, "a"): "recovered"}


def test_only_a_missing_state_is_empty(spark, tmp_path):
    import pytest
    from fleetspark.sources.state import load_alert_state, state_path
    assert load_alert_state(spark, str(tmp_path), 5).count() == 0
    broken = state_path(str(tmp_path), 6)
    (tmp_path / "run=6").mkdir()
    (tmp_path / "run=6" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        load_alert_state(spark, str(tmp_path), 6).count()
    assert broken.endswith("run=6")


def test_a_failing_instance_is_a_finding(spark):
    from fleetspark.plans.health_check import run_checks
    schema = "instance string, check string, entity string, text string"

    def broken():
        return spark.createDataFrame([("b", "c", "e", "t")], schema).selectExpr(
            "instance", "check", "entity", "cast(raise_error('no access') as string) as text")

    found = run_checks(spark, {"a": lambda: spark.createDataFrame([("a", "cap", "", "too many")], schema), "b": broken,
                               "c": lambda: 1 / 0})
    rows = {r.instance: (r.check, r.text) for r in found.collect()}
    assert rows["a"] == ("cap", "too many")
    assert rows["b"][0] == rows["c"][0] == "error"
    assert rows["c"][1] == "[c] watchdog check errored: ZeroDivisionError: division by zero"


def test_group_by_id_findings(spark):
    from fleetspark.operators import health as hl
    configured = spark.createDataFrame([("app", "app"), ("api", "api")], "key string, name string")
    groups = spark.createDataFrame([("app", 4, "g"), ("api", 5, "g"), ("api", None, "h")],
                                   "repository string, group_id int, group_name string")
    found = hl.repo_scope_findings(configured, configured, groups, None, "i", "acme", group_id=4).collect()
    assert [r.text for r in found] == ["[i] configured runner group 4 is unavailable to acme/api"]


def test_applied_passes_leave_the_log_and_replays_change_nothing(spark):
    from fleetspark.sources.state import saved_runs, subfolders
    from fleetspark.streaming.alerts import KEPT_STATES, alert_stream
    src = scratch_path(spark, "alert-src")
    schema = "pass_id long, now_epoch double, key string, text string"
    t = 1.7e9
    files = [[(1, t, "a", "A")], [(1, t, None, None), (2, t + 60, "a", "A")], [(2, t + 60, "b", "B"), (2, t + 60, None, None)],
             [(3, t + 120, "b", "B"), (3, t + 120, None, None)], [(3, t + 120, "late", "L"), (5, t + 180, "c", "C")]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/part{i}")

    def start(checkpoint):
        stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
                  .option("recursiveFileLookup", "true").parquet(src))
        alert_stream(stream, 3600, state, out, checkpoint).awaitTermination()
        return {(r.pass_id, r.key): r.status for r in spark.read.parquet(out).collect()}

    out, state = scratch_path(spark, "alert-out"), scratch_path(spark, "alert-state")
    expected = {(1, "a"): "fresh", (2, "a"): "suppressed", (2, "b"): "fresh", (3, "b"): "suppressed", (3, "a"): "recovered"}
    assert start(scratch_path(spark, "alert-ckpt")) == expected
    assert subfolders(spark, f"{state}/findings") == ["pass_id=5"]  # the open pass
    assert saved_runs(spark, f"{state}/states") == [2, 3] and KEPT_STATES == 2
    assert start(scratch_path(spark, "alert-ckpt")) == expected  # every micro-batch again
