"""Hand-worked results, plus property checks."""

import json
import random

from pyspark.sql import functions as F

from fleetspark.operators import apilog as ap
from fleetspark.operators import cycles as cy
from fleetspark.operators import demand as dm
from fleetspark.operators import labels as lb
from fleetspark.plans.audit_report import audit_report
from fleetspark.plans.reconcile import reconcile_repos

FLEET = [("self-hosted,daytona,pool", 0), ("self-hosted,daytona,pool,large", 1)]


def classes(spark, rows=FLEET, caps=None):
    caps = caps or {}
    data = [(pos, name, labels.split(","), 0, caps.get(name)) for (labels, pos), name in
            zip(rows, ["default", "large", "xl", "xxl"][:len(rows)])]
    return spark.createDataFrame(data, "class_pos int, name string, labels array<string>, min_idle int, max_live int")


def test_webhook_label_match_table(spark):
    cases = [(1, ["self-hosted", "daytona", "pool"]), (2, ["self-hosted", "daytona", "pool", "large", "extra"]),
             (3, ["ubuntu-latest"]), (4, []), (5, None)]
    df = spark.createDataFrame(cases, "id int, labels array<string>")
    got = {r.id: r.labels_match for r in lb.webhook_labels_match(df, classes(spark)).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_match_class_fewest_labels_then_config_order(spark):
    cls = classes(spark, [("a,b,c", 0), ("a,b", 1), ("b,a", 2)])
    jobs = spark.createDataFrame([(1, ["a"]), (2, ["a", "c"]), (3, ["z"]), (4, [])], "job_id int, labels array<string>")
    got = {r.job_id: r.size_class for r in lb.match_class(jobs, cls).collect()}
    assert got == {1: "large", 2: "default", 3: None, 4: None}


def test_cycle_record_golden(spark):
    marks = spark.createDataFrame([(60.0, 61.5, 65.5, 66.0, 67.25, 70.0, 71.0, 101.0, 111.5, "job")],
                                  "spawned_at double, jit_started_at double, jit_completed_at double, "
                                  "sandbox_started_at double, sandbox_ready_at double, runner_command_started_at double, "
                                  "busy_at double, completed_at double, allocation_completed_at double, outcome string")
    r = cy.derive_cycle_record(marks).collect()[0]
    assert (r.jit_mint_secs, r.sandbox_create_secs, r.runner_start_secs, r.launch_secs) == (4.0, 1.25, 2.75, 4.0)
    assert (r.idle_secs, r.busy_secs, r.teardown_secs, r.total_secs, r.allocated_secs) == (1.0, 30.0, 10.5, 41.0, 45.5)
    assert r.job_phase_observed is True
    assert (r.started_at, r.busy_at, r.completed_at) == ("1970-01-01T00:01:00.000Z", "1970-01-01T00:01:11.000Z",
                                                          "1970-01-01T00:01:41.000Z")


def test_outcome_rules(spark):
    df = spark.createDataFrame([("runner_exit", None, 0), ("runner_exit", None, 2), ("runner_exit", 5.0, 2),
                                ("session_unreadable", None, None), ("session_unreadable", 3.0, None),
                                ("job_max", 1.0, None), ("drain", None, None), ("exception", None, None)],
                               "ended_by string, busy_at double, exit_code int")
    got = [tuple(r.o) for r in df.select(cy.classify_outcome(F.col("ended_by"), F.col("busy_at"), F.col("exit_code"))
                                         .alias("o")).collect()]
    assert got == [("job", "runner_exit"), ("failed", "runner_exit"), ("job", "runner_exit"),
                   ("unknown", "session_unreadable"), ("job", "session_unreadable"), ("job", "job_max_secs"),
                   ("idle", "drain"), ("failed", "cycle_failed")]


def _log(spark, rows):
    return spark.createDataFrame(
        [(i, f"2024-01-01 00:00:{i:02d}", "f0", s, ra, rs, rem, tick) for i, (s, ra, rs, rem, tick) in enumerate(rows)],
        "event_id int, ts string, fleet string, status int, retry_after string, reset string, remaining string, "
        "tick_completed boolean").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_fallback_backoff_bounded(spark):
    # the tick holding the six failures does not reset; the next clean tick does
    log = _log(spark, [(403, None, None, None, False)] * 6 + [(200, None, None, None, True), (429, None, None, None, False),
                                                             (200, None, None, None, True), (200, None, None, None, True),
                                                             (429, None, None, None, False)])
    d = ap.directed_delay(F.col("retry_after"), F.col("reset"), F.col("remaining"), F.lit(1704067200.0))
    got = [r.cooldown_secs for r in ap.backoff_sequence(log, directed=d).orderBy("event_id").collect()]
    assert got == [60.0, 120.0, 240.0, 480.0, 900.0, 900.0, None, 900.0, None, None, 60.0]


def test_partial_tick_does_not_reset(spark):
    log = _log(spark, [(403, None, None, None, False), (200, None, None, None, True),
                       (200, None, None, None, False), (403, None, None, None, False), (200, None, None, None, True),
                       (403, None, None, None, False)])
    got = [r.cooldown_secs for r in ap.backoff_sequence(log).orderBy("event_id").collect()]
    assert got == [60.0, None, None, 120.0, None, 240.0]


def test_delays_from_headers(spark):
    """Fractions and blanks are read; words, negative waits, past resets and remaining quota fall back, which doubles."""
    now = 1704067200.0
    log = _log(spark, [(429, " 12.5 ", None, None, False), (403, "soon", str(int(now + 41)), " 0 ", False),
                       (403, "-3", None, "0", False), (429, "0", None, None, False),
                       (403, None, str(int(now - 5)), "0", False), (429, None, str(int(now + 41)), "7", False)])
    d = ap.directed_delay(F.col("retry_after"), F.col("reset"), F.col("remaining"), F.lit(now))
    rows = ap.backoff_sequence(log, directed=d).orderBy("event_id").collect()
    assert [(r.cooldown_secs, r.cooldown_source) for r in rows] == [
        (12.5, "retry-after"), (41.0, "rate-limit-reset"), (60.0, "exponential-fallback"), (0.0, "retry-after"),
        (120.0, "exponential-fallback"), (240.0, "exponential-fallback")]


def test_audit_of_a_small_inventory(spark):
    """Three builds of one image (one of them idle), a name used twice, a snapshot nobody names, a name without a snapshot."""
    one, two, three = ({"imageName": f"registry.test/ci/base:{i}", "cpu": 2 ** i, "mem": 8, "disk": 20, "gpu": 0,
                        "sandboxClass": "small", "regionIds": ["north"], "createdAt": "2023-03-01T00:00:00Z"} for i in (1, 2, 3))
    items = [{"id": "s1", "name": "amber", "state": "active", "size": 7, **one}, {"id": "s2", "name": "birch", "state": "active", "size": 7, **one},
             {"id": "s3", "name": "birch", "state": "active", "size": 3, **two}, {"id": "s4", "name": "cedar", "state": "inactive", "size": 7, **one},
             {"id": "s5", "name": "dune", "state": "active", "size": 9, **three}]
    refs = spark.createDataFrame([("amber", "hill", "hill.toml", "default"), ("birch", "vale", "vale.toml", "default"),
                                  ("cedar", "vale", "vale.toml", "large"), ("elm", "wold", "wold.toml", "large")],
                                 "snapshot string, fleet string, profile string, size_class string")
    rep = audit_report(spark.createDataFrame([(json.dumps(items),)], "payload string"), refs, checkpoint=True)
    assert rep["summary"].collect()[0].asDict() == {
        "snapshot_count": 5, "referenced_snapshot_count": 2, "ambiguous_snapshot_count": 2,
        "unreferenced_snapshot_count": 1, "unresolved_profile_reference_count": 1, "name_collision_count": 1,
        "duplicate_candidate_count": 1, "shared_candidate_count": 1}
    cand = rep["duplicate_candidates"].collect()[0]
    assert cand.shared_candidate and not cand.all_active and cand.fleets == ["hill", "vale"]
    assert cand.potential_reclaimable_size == 2 * 7
    assert sorted(r.snapshot_id for r in rep["candidate_members"].collect()) == ["s1", "s2", "s4"]
    assert [tuple(r) for r in rep["unreferenced_snapshots"].collect()] == [("s5", "dune")]


def test_three_repositories_share_a_cap(spark):
    """lake wants 2, moor 2 with an idle runner of its own, reef 1; the runner counts for moor and for the cap only."""
    labels = ["self-hosted", "daytona", "pool"]
    wanted = [("lake", 2), ("moor", 2), ("reef", 1)]
    queued = [(10 * p + i, p, name, "queued", labels) for p, (name, n) in enumerate(wanted) for i in range(n)]
    jobs = spark.createDataFrame(queued, "job_id int, run_id int, repository string, status string, labels array<string>")
    runs = spark.createDataFrame([(n, p, "queued") for p, (n, _) in enumerate(wanted)], "repository string, run_id int, status string")
    repos = spark.createDataFrame([(n, p) for p, (n, _) in enumerate(wanted)], "repository string, repo_pos int")
    registry = spark.createDataFrame([(5, "default", "IDLE", "moor", 70)],
                                     "cycle_id long, cls_name string, state string, repository string, runner_id long")
    runners = spark.createDataFrame([], "runner_id long, repository string, busy boolean")

    def spawned(cap):
        cls = classes(spark, [(",".join(labels), 0)], caps={"default": cap})
        plan, _ = reconcile_repos(runs, jobs, cls, registry, runners, repos, 300)
        return {r.repository: r.to_spawn for r in plan.collect()}

    assert spawned(3) == {"lake": 2, "moor": 0, "reef": 0}
    assert spawned(4) == {"lake": 2, "moor": 1, "reef": 0}
    assert spawned(9) == {"lake": 2, "moor": 1, "reef": 1}


def test_greedy_share_equals_loop(spark):
    rnd = random.Random(3)
    rows, expected = [], {}
    for case in range(60):
        cap = rnd.randint(0, 8)
        avail, deficits = cap, [rnd.randint(0, 4) for _ in range(rnd.randint(1, 6))]
        for pos, d in enumerate(deficits):
            take = min(d, avail)
            avail -= take
            expected[(case, pos)] = take
            rows.append((f"c{case}", f"r{pos}", pos, d, cap))
    demand = spark.createDataFrame([(r, c, d) for c, r, _, d, _ in rows], "repository string, size_class string, queued long")
    repos = spark.createDataFrame(sorted({(r, p) for _, r, p, _, _ in rows}), "repository string, repo_pos int")
    cls = spark.createDataFrame(sorted({(c, cap) for c, _, _, _, cap in rows}), "name string, max_live int")
    supply = spark.createDataFrame([], "repository string, size_class string, supply long, live long")
    got = {(int(r.size_class[1:]), int(r.repository[1:])): r.to_spawn
           for r in dm.spawn_plan_repo(demand, supply, cls, repos).collect()}
    assert got == expected
