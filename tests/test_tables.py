"""Hand-worked cases: inputs and the results written down beside them."""

import hashlib
import hmac
import json

import pytest

from fleetspark.fixed import PROJECT, Project
from fleetspark.operators import audit as au
from fleetspark.operators import rules as rl
from fleetspark.operators import telemetry as tm
from fleetspark.operators import textscan as ts
from fleetspark.operators.labels import label_sets
from fleetspark.operators.webhook import deliveries_status
from fleetspark.sources.journal import TELEMETRY_PREFIX, parse_cycle_telemetry

NEW = "runs-on: [self-hosted, daytona]"

RUNS_ON = [  # line, rewritten line or None
    ("runs-on: ubuntu-latest", NEW),
    ("    runs-on:  ubuntu-24.04-arm  ", "    " + NEW),
    ("  runs-on: 'ubuntu-22.04'", "  " + NEW),
    ("runs-on: blacksmith-2vcpu", NEW),
    ("runs-on: acme", NEW),
    ("runs-on: acme-2", None),
    ("runs-on: [ubuntu-latest]", NEW),
    ('runs-on: [ self-hosted , "acme" ]', NEW),
    ("runs-on: [self-hosted, macos]", None),
    ("runs-on: [gpu, linux]", None),
    ("runs-on: [daytona, self-hosted]", None),
    ("runs-on: ${{ inputs.runner }}", None),
    ("runs-on: windows-2025", None),
    ("# runs-on: ubuntu-latest", None),
]


def test_runs_on_lines(spark):
    df = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(RUNS_ON)], "n int, text string")
    got = {r.n: r.new_line for r in ts.runs_on_rewrite(df, project=Project("acme", "Acme App")).collect()}
    assert got == {i: new for i, (_, new) in enumerate(RUNS_ON) if new}


USES = [  # line, unpinned reference or None
    ("uses: acme/build@v2", "acme/build@v2"),
    ("  uses: 'acme/build@main'  # latest", "acme/build@main"),
    ("uses: acme/build@" + "9" * 40, None),
    ('uses: "acme/build@' + "aB" * 20 + '"', None),
    ("uses: acme/build@" + "9" * 41, "acme/build@" + "9" * 41),
    ("uses: ./.github/actions/x", None),
    ("uses: docker://ghcr.io/x", None),
    ("- uses: acme/build@v2", None),
    ("uses: # nothing", None),
]


def test_uses_lines(spark):
    df = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(USES)], "n int, text string")
    got = {r.n: r.ref for r in ts.unpinned_uses(df).collect()}
    assert got == {i: ref for i, (_, ref) in enumerate(USES) if ref}


SNAPSHOTS = [  # raw object, expected values (only the named ones are compared)
    ({"id": "a", "name": "n", "size": 3}, {"snapshot_id": "a", "name": "n", "size": 3.0}),
    ({"id": 4, "name": "", "size": -1}, {"snapshot_id": None, "name": None, "size": None}),
    ({"createdAt": None, "created_at": "x"}, {"created_at": None}),
    ({"created_at": "x", "image": "i", "image_name": "j"}, {"created_at": "x", "image_name": "j"}),
    ({"cpu": True, "resources": {"cpu": 2}}, {"cpu": None}),
    ({"resources": {"cpu": 2, "memory": 4.5, "gpu": 0}}, {"cpu": 2.0, "memory_gib": 4.5, "gpu": 0.0}),
    ({"resources": "big", "mem": "4"}, {"cpu": None, "memory_gib": None}),
    ({"buildInfo": {"snapshot_ref": "r"}}, {"snapshot_ref": "r"}),
    ({"buildInfo": 1, "build_info": {"snapshotRef": "r"}}, {"snapshot_ref": None}),
    ({"ref": "", "buildInfo": {"snapshotRef": "r"}}, {"snapshot_ref": None}),
    ({"regionIds": ["us", "", 5, "eu"]}, {"region_ids": ["eu", "us"]}),
    ({"regionIds": "us", "region_ids": ["eu"]}, {"region_ids": []}),
]


def test_snapshot_objects(spark):
    df = spark.createDataFrame([(i, json.dumps(raw)) for i, (raw, _) in enumerate(SNAPSHOTS)], "pos int, raw string")
    rows = {r.pos: r for r in au.normalize_snapshot(df, keep=["pos"]).collect()}
    for i, (raw, expected) in enumerate(SNAPSHOTS):
        assert {k: rows[i][k] for k in expected} == expected, raw


QUEUED = '{"action":"queued","workflow_job":{"labels":["pool","self-hosted","x"]}}'
DELIVERIES = [  # path, length, signature (True: right one), event, body, status, wake
    ("/github", None, True, "workflow_job", QUEUED, 202, True),
    ("/", None, True, "workflow_job", QUEUED.replace("queued", "done"), 202, False),
    ("/webhook", None, True, "workflow_job", QUEUED.replace("pool", "other"), 202, False),
    ("/webhook", None, True, "workflow_job", '{"action":"queued","workflow_job":{"labels":[1,""]}}', 202, False),
    ("/webhook", None, True, "workflow_job", '{"action":"queued","workflow_job":[]}', 202, False),
    ("/webhook", None, True, "push", QUEUED, 202, False),
    ("/webhook", None, True, "ping", "anything", 200, False),
    ("/webhook", None, True, "workflow_job", "anything", 400, False),
    ("/webhook", None, True, "workflow_job", "[]", 400, False),
    ("/elsewhere", None, True, "workflow_job", QUEUED, 404, False),
    ("/github", "many", True, "workflow_job", QUEUED, 400, False),
    ("/github", "-3", True, "workflow_job", QUEUED, 413, False),
    ("/github", str(1024 * 1024 + 1), True, "workflow_job", QUEUED, 413, False),
    ("/github", None, None, "workflow_job", QUEUED, 401, False),
    ("/github", None, "sha256=00", "ping", QUEUED, 401, False),
]


def test_deliveries(spark):
    secret = b"key"
    rows = []
    for i, (path, length, signature, event, body, _, _) in enumerate(DELIVERIES):
        right = "sha256=" + hmac.new(secret, body.encode(), hashlib.sha256).hexdigest()
        rows.append((i, path, length or str(len(body)), right if signature is True else signature, event, body))
    df = spark.createDataFrame(rows, "event_id int, path string, content_length string, signature string, event string, body string")
    got = {r.event_id: (r.status, r.wake) for r in deliveries_status(df, secret, label_sets([["self-hosted", "pool"]])).collect()}
    assert got == {i: (d[5], d[6]) for i, d in enumerate(DELIVERIES)}


def usage(spark, records):
    base = {"event": "runner_cycle_complete", "schema_version": 1}
    df = spark.createDataFrame([(TELEMETRY_PREFIX + json.dumps(base | r),) for r in records], "line string")
    return {r.snapshot: r.line for r in tm.usage_report_lines(tm.usage_summary(parse_cycle_telemetry(df))).collect()}


def test_usage_line_of_twenty_durations(spark):
    """Durations 1..20 minutes: mean 10.5, the 95th percentile by nearest rank is the 19th; 2 cores for 210 minutes."""
    records = [{"snapshot": "img", "outcome": "job" if m % 4 else "failed", "cleanup_status": "deleted", "total_secs": 60 * m,
                "allocated_secs": 60 * m, "declared_resources": {"cpu": 2, "memory_gib": 8, "disk_gib": 1}} for m in range(1, 21)]
    assert usage(spark, records) == {"img": "img: n=20 job=15 idle=0 failed=5 unknown=0 avg=10.50m p95=19.00m; "
                                            "allocated=7.00 CPU-h/28.00 GiB-h RAM/3.50 GiB-h disk"}


def test_usage_line_needs_every_sample(spark):
    """One unusable duration or allocation hides the figure and shows its coverage; never-created cycles count as covered."""
    records = [{"snapshot": "img", "outcome": "idle", "cleanup_status": "deleted", "total_secs": True, "allocated_secs": 5,
                "declared_resources": {"cpu": 1, "memory_gib": 1, "disk_gib": 1}},
               {"snapshot": "img", "outcome": "later", "cleanup_status": "create_not_attempted", "total_secs": 30},
               {"snapshot": "img", "outcome": "job", "cleanup_status": "delete_failed", "total_secs": 30, "allocated_secs": 30}]
    assert usage(spark, records) == {"img": "img: n=3 job=1 idle=1 failed=0 unknown=1 duration unavailable (coverage=2/3); "
                                            "allocation unavailable (coverage=2/3)"}


def test_usage_line_with_stages(spark):
    record = {"snapshot": "s", "outcome": "job", "cleanup_status": "create_not_attempted", "total_secs": 120}
    records = [record | {"jit_mint_secs": 1.5, "busy_secs": 60}, record | {"jit_mint_secs": 2.5, "busy_secs": None}]
    assert "avg=2.00m p95=2.00m; stages p95 jit_mint=2.50s; allocated=0.00" in usage(spark, records)["s"]


NETWORKS = [  # text, valid, private, normalised prefix length
    ("10.0.0.0/8", True, True, 8), ("10.0.0.1", True, True, 32), ("10.0.0.0/255.0.0.0", True, True, 8),
    ("10.0.0.0/0.255.255.255", True, True, 8), ("10.0.0.0/255.0.255.0", False, False, None),
    ("10.0.0.1/8", False, False, None), ("8.8.8.8", True, False, 32), ("10.0.0.0/33", False, False, None),
    ("010.0.0.0/8", False, False, None), ("10.0.0/8", False, False, None), ("", False, False, None),
    ("192.168.0.0/008", False, False, None), ("192.168.4.0/022", True, True, 22), ("10.0.0.256", False, False, None),
]


def test_networks(spark):
    df = spark.createDataFrame([(i, n[0]) for i, n in enumerate(NETWORKS)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", rl.cidr_checks(df["t"]).alias("c")).collect()}
    for i, (text, valid, private, bits) in enumerate(NETWORKS):
        assert (got[i].valid, got[i].private) == (valid, private), text
        assert (got[i].normalised is None) == (not valid) and (not valid or got[i].normalised.endswith(f"/{bits}")), text


def profile(**changes):
    base = dict(fleet_pos=1, profile="p.toml", manifest_version=1, scope="repository", owner="Acme", repositories="app",
                network_policy="deny-by-default", routing_labels="edge", runner_group="edge", config_paths="github.scope,poller.interval_secs",
                hold_on_failure_secs=None, idle_poll_secs=5, fast_idle_poll_secs=None, fast_idle_window_secs=None, busy_poll_secs=5,
                job_max_secs=None, idle_refresh_secs=None, demand_idle_secs=None, auto_stop_minutes=None, watchdog_enabled="true",
                listen_host="0.0.0.0", listen_port=80, secret_env="HOOK", installation_id=7, configured_installation_id=7,
                target_type="User", login="acme", repository_selection="all")
    return base | changes


PROFILES = [  # change, rules that fail
    ({}, set()),
    ({"routing_labels": "edge,other"}, {"R12_label_group"}),
    ({"routing_labels": None}, {"R12_routing_missing"}),
    ({"network_policy": None}, {"R12_routing_without_network", "R12_group_reserved"}),
    ({"network_policy": None, "routing_labels": None, "runner_group": None}, set()),
    ({"routing_labels": PROJECT.label, "runner_group": PROJECT.label}, {"R12_label_shared"}),
    ({"config_paths": "poller.colour"}, {"R5_unknown_key"}),
    ({"config_paths": "github.org"}, {"R5_unknown_key"}),
    ({"config_paths": "report.anything"}, set()),
    ({"secret_env": "_A"}, {"R15_secret_env"}),
    ({"secret_env": "A" * 65}, {"R15_secret_env"}),
    ({"listen_host": None, "listen_port": None}, {"R15_listen_host", "R15_listen_port"}),
    ({"listen_host": None, "listen_port": None, "secret_env": None}, set()),  # no webhook section
    ({"secret_env": None}, set()),
    ({"config_paths": "network.policy,network.domain_allow_list"}, set()),
    ({"config_paths": "network.policy,network.bogus"}, {"R5_unknown_key"}),
    ({"demand_idle_secs": -1}, {"R16_negative"}),
    ({"fast_idle_poll_secs": 0}, {"R16_poll"}),
    ({"repositories": None}, {"R8_repositories_empty"}),
    ({"installation_id": 8}, {"R23_installation_id"}),
    ({"manifest_version": None}, {"R1_manifest_version"}),
]
_TYPES = ("fleet_pos long, profile string, manifest_version int, scope string, owner string, repositories string, "
          "network_policy string, routing_labels string, runner_group string, config_paths string, hold_on_failure_secs int, "
          "idle_poll_secs int, fast_idle_poll_secs int, fast_idle_window_secs int, busy_poll_secs int, job_max_secs int, "
          "idle_refresh_secs int, demand_idle_secs int, auto_stop_minutes int, watchdog_enabled string, listen_host string, "
          "listen_port int, secret_env string, installation_id int, configured_installation_id int, target_type string, "
          "login string, repository_selection string")


def test_profile_rules(spark):
    rows = [tuple(profile(fleet_pos=i, **change).values()) for i, (change, _) in enumerate(PROFILES)]
    got = {}
    for r in rl.profile_rule_violations(spark.createDataFrame(rows, _TYPES)).collect():
        got.setdefault(r.fleet_pos, set()).add(r.rule_id)
    for i, (change, failed) in enumerate(PROFILES):
        assert got.get(i, set()) == failed, change


CLASSES = [  # labels, min_idle, max, reason, routing labels of the fleet, rules that fail
    ("self-hosted,daytona", 0, 4, None, None, set()),
    ("self-hosted,daytona", None, None, None, None, {"R19_min_idle", "R19_max"}),
    ("self-hosted,daytona", 2, 4, "  ", None, {"R20_warm_floor_reason"}),
    ("self-hosted,daytona", 0, 4, "why", None, {"R20_warm_floor_reason"}),
    (None, 0, 4, None, None, {"R18_labels"}),
    ("self-hosted,edge", 0, 4, None, "edge", set()),
    ("self-hosted,edge,daytona", 0, 4, None, "edge", {"R18_routing_shared"}),
    ("self-hosted", 0, 4, None, "edge", {"R18_routing_missing"}),
]


def test_class_rules(spark):
    classes = spark.createDataFrame([(f"p{i}", i, f"c{i}", *c[:4], "snap") for i, c in enumerate(CLASSES)]
                                    + [("s", 90, "x", "self-hosted,daytona", 0, 1, None, s) for s in (None, " ")],
                                    "profile string, class_pos long, name string, labels string, min_idle int, max_live int, "
                                    "warm_floor_reason string, snapshot string")
    fleets = spark.createDataFrame([(f"p{i}", "organization", c[4]) for i, c in enumerate(CLASSES)] + [("bare", "organization", None)],
                                   "profile string, scope string, routing_labels string")
    got = {}
    for r in rl.class_rule_violations(classes, fleets).collect():
        if r.rule_id != "R21_required_class":
            got.setdefault(r.profile, set()).add(r.rule_id)
    for i, c in enumerate(CLASSES):
        assert got.get(f"p{i}", set()) == c[5], c
    assert got["s"] == {"R19_snapshot", "R18_unique_name"} and got["bare"] == {"R18_no_class"}
    missing = {r.name for r in rl.class_rule_violations(classes, fleets).where("profile = 'bare' and rule_no = 21").collect()}
    assert missing == {"default", "large"}


def test_reference_status_with_null_names(spark):
    """Members that share a null id and name must not multiply the snapshots that have them."""
    snaps = spark.createDataFrame([("a", "n"), (None, None), (None, None), (None, None), ("b", None)],
                                  "snapshot_id string, name string")
    members = spark.createDataFrame([(None, None, "candidate-002"), (None, None, "candidate-001"), (None, None, "candidate-001"),
                                     ("a", "n", "candidate-001")], "snapshot_id string, name string, candidate_id string")
    refs = spark.createDataFrame([("n", "f")], "snapshot string, fleet string")
    status = au.snapshot_reference_status(snaps, refs, spark.createDataFrame([], "snapshot_name string"), members).collect()
    assert len(status) == 5
    assert sorted((r.snapshot_id or "", r.reference_status, r.duplicate_candidate) for r in status if r.duplicate_candidate) == [
        ("", "unreferenced", "candidate-001")] * 3 + [("a", "referenced", "candidate-001")]


@pytest.mark.parametrize("cell", [-1, 5])
def test_page_limit_is_a_parameter(spark, cell):
    pages = spark.createDataFrame([(1, 1, 2), (2, 2, 2)], "position long, page long, total_pages long")
    found = {r.violation for r in au.page_consistency(pages, max_pages=cell).collect()}
    assert found == ({"invalid_total_pages"} if cell < 2 else set())
