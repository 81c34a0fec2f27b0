"""Nested profile and manifest documents: the walk against Python, rules by presence and type."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetspark.operators import profiles as pf
from fleetspark.operators import rules as rl


def _nodes(value, path="", depth=0):
    if isinstance(value, dict):
        pairs = [(f"{path}.{k}" if path else k, k, v) for k, v in value.items()]
    elif isinstance(value, list):
        pairs = [(f"{path}[{i}]", None, v) for i, v in enumerate(value)]
    else:
        return
    names = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", type(None): "null"}
    for own, key, v in pairs:
        text = json.dumps(v) if isinstance(v, (bool, int)) else v if isinstance(v, str) else None
        yield (own, path, key, depth + 1, names[type(v)], text)
        yield from _nodes(v, own, depth + 1)


def _walked(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    return sorted((tuple(r) for r in pf.walk(docs, ["id"]).collect()), key=repr)


LEAF = st.none() | st.booleans() | st.integers(-10**12, 10**12) | st.text(alphabet='ab[]{}"\\,: é\n', max_size=6)
TREE = st.recursive(LEAF, lambda inner: st.lists(inner, max_size=3) | st.dictionaries(
    st.text(alphabet="abcé", min_size=1, max_size=3), inner, max_size=3), max_leaves=12)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.dictionaries(st.text(alphabet="xyz", min_size=1, max_size=2), TREE, max_size=4), max_size=6))
def test_walk_is_the_recursion(spark, trees):
    expected = [(i, *n) for i, t in enumerate(trees) for n in _nodes(t)]
    assert _walked(spark, [json.dumps(t) for t in trees]) == sorted(expected, key=repr)


def test_walk_goes_on_below_one_stage(spark):
    deep = 1
    for i in range(2 * pf.LEVELS + 3):
        deep = {"k": deep} if i % 2 else [deep, "]}"]
    tree = {"top": deep, "flat": "{[("}
    assert _walked(spark, [json.dumps(tree)]) == sorted([(0, *n) for n in _nodes(tree)], key=repr)


def test_texts_of_one_task_are_walked_by_all(spark):
    trees = [{"a": {"b": [i, {"c": {"d": {"e": i}}}]}} for i in range(200)]
    docs = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "id long, body string").coalesce(1)
    nodes = pf.walk(docs, ["id"])
    spread = {r.task: r.n for r in nodes.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("id").alias("n")).collect()}
    assert len(spread) >= 4 and max(spread.values()) < 100
    assert nodes.count() == sum(1 for t in trees for _ in _nodes(t))


@pytest.mark.parametrize("text", [None, "", "no", "[]", '"x"', '{"a":1,"a":2}', '{"a":'])
def test_what_cannot_be_read(spark, text):
    docs = spark.createDataFrame([(1, "organization", "o", text)], "id long, scope string, owner string, body string")
    assert pf.walk(docs, ["id"]).count() == 0
    assert [tuple(r) for r in pf.profile_document_violations(docs, ["id"]).collect()] == [(1, "", 5, "R5_unreadable")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "id long, scope string, owner string, body string")
    for found in (pf.walk(docs, ["id"]), pf.profile_document_violations(docs, ["id"]), pf.class_document_violations(docs, ["id"]),
                  pf.manifest_violations(docs.select("id", "body"), ["id"])):
        assert found.count() == 0


CLASS = {"name": "default", "labels": ["self-hosted", "daytona"], "snapshot": "s", "min_idle": 0, "max": 1}
GOOD = {"github": {"org": "Acme", "runner_group": "daytona"}, "daytona": {"target": "us"},
        "size_class": [CLASS, {**CLASS, "name": "large", "labels": ["self-hosted", "daytona", "large"]}]}
REPO = {"github": {"scope": "repository", "owner": "Acme", "runner_group": "edge", "repositories": ["app"]}, "daytona": {"target": "us"},
        "network": {"policy": "deny-by-default", "cidr_allow_list": ["10.0.0.0/8"], "domain_allow_list": ["a.org"]},
        "routing": {"required_labels": ["edge"]}, "size_class": [CLASS]}


def _found(spark, *cases):
    rows = [(i, "repository" if d.get("github", {}) and "owner" in d["github"] else "organization", "Acme", json.dumps(d), "x")
            for i, d in enumerate(cases)]
    docs = spark.createDataFrame(rows, "id long, scope string, owner string, body string, path string")
    out = [set() for _ in cases]
    for r in pf.profile_document_violations(docs, ["id"]).collect():
        out[r.id].add((r.rule_id, r.path))
    return out


def test_absent_section_absent_key_and_wrong_type_differ(spark):
    def plus(base=GOOD, **sections):
        return {**base, **sections}

    cases = {
        "good": (plus(), set()),
        "repo": (plus(REPO), set()),
        "null section": (plus(poller=None, webhook=None, network=None), set()),
        "no key": (plus(cache={}, poller={}, webhook={}),
                   {("R13_key_missing", "cache.volume"), ("R14_key_missing", "poller.interval_secs"), ("R15_key_missing", "webhook.listen")}),
        "type": (plus(cache={"volume": 1}, poller={"interval_secs": "5"}, webhook={"listen": None}),
                 {("R13_key_type", "cache.volume"), ("R14_key_type", "poller.interval_secs"), ("R15_key_type", "webhook.listen")}),
        "section type": (plus(cache=[], poller=3, webhook="x", lifecycle=[], watchdog=False),
                         {(f"R{n}_section_type", s) for n, s in ((13, "cache"), (14, "poller"), (15, "webhook"), (16, "lifecycle"),
                                                                (17, "watchdog"))}),
        "values": (plus(cache={"volume": " "}, poller={"interval_secs": 0, "request_spacing_secs": -1}, webhook={"listen": "[::]:80"}),
                   {("R13_cache_volume", "cache.volume"), ("R14_poll_interval", "poller.interval_secs"),
                    ("R14_request_spacing", "poller.request_spacing_secs"), ("R15_listen_host", "webhook.listen")}),
        "keys": (plus(poller={"interval_secs": 1, "x": {"y": [{"my_token": 1}]}}, other={"anything": 1}),
                 {("R5_unknown_key", "poller.x"), ("R22_forbidden_key", "poller.x.y[0].my_token")}),
        "no network": ({k: v for k, v in REPO.items() if k != "network"},
                       {("R12_routing_without_network", "routing"), ("R12_group_reserved", "github.runner_group")}),
        "empty network": (plus(REPO, network={}), {("R10_key_missing", f"network.{k}")
                                                   for k in ("policy", "cidr_allow_list", "domain_allow_list")}),
        "no github": ({k: v for k, v in GOOD.items() if k != "github"}, {("R6_section_missing", "github")}),
        "no class": (plus(size_class=[]), {("R18_no_class", "size_class")}),
        "commas": (plus(REPO, network={**REPO["network"], "cidr_allow_list": ["10.0.0.0/8,10.1.0.0/16"]}),
                   {("R10_cidr_invalid", "network.cidr_allow_list")}),
    }
    found = _found(spark, *[d for d, _ in cases.values()])
    assert dict(zip(cases, found)) == {name: want for name, (_, want) in cases.items()}


def test_classes_of_documents(spark):
    bad = {**GOOD, "size_class": [5, {"name": None, "labels": ["x", ""], "min_idle": True, "max": 1.5}, CLASS]}
    docs = spark.createDataFrame([("good", json.dumps(GOOD)), ("bad", json.dumps(bad))], "profile string, body string")
    found = {(r.profile, r.path, r.rule_id) for r in pf.class_document_violations(docs, ["profile"]).collect()}
    at = "size_class[1]"
    assert found == {("bad", "size_class[0]", "R18_class_type"), ("bad", f"{at}.name", "R18_key_type"), ("bad", f"{at}.labels", "R18_label_type"),
                     ("bad", f"{at}.snapshot", "R19_key_missing"), ("bad", f"{at}.min_idle", "R19_key_type"), ("bad", f"{at}.max", "R19_key_type")}
    fleets = spark.createDataFrame([("good", "organization", None)], "profile string, scope string, routing_labels string")
    table = pf.class_table(docs.where("profile = 'good'"), "profile")
    assert rl.class_rule_violations(table, fleets).count() == 0


def test_manifest_entries(spark):
    entry = {"name": "alder", "organization": "Acme", "profile": "config/fleets/alder/runners.toml", "installation_id_key": "7"}
    texts = [json.dumps({"manifest": {"version": 1}, "fleet": fleet}) for fleet in (
        [entry], [], [entry, {**entry, "organization": "ACME"}], [{**entry, "owner": "Acme"}, 4],
        [{**entry, "scope": "repository"}], [{**entry, "scope": 1}, {**entry, "installation_id_key": "07", "name": "birch", "organization": "b"}])]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    found = {(r.id, r.rule_id, r.path) for r in pf.manifest_violations(docs, ["id"]).collect()}
    assert found == {
        (1, "R1_no_fleet", "fleet"), (2, "R2_fleet_unique", "fleet[1].name"), (2, "R3_scope_owner_unique", "fleet[1].owner"),
        (3, "R5_unknown_key", "fleet[0].owner"), (3, "R1_entry_type", "fleet[1]"), (4, "R5_unknown_key", "fleet[0].organization"),
        (4, "R3_owner_name", "fleet[0].owner"), (5, "R4_scope", "fleet[0].scope"), (5, "R9_installation_key", "fleet[1].installation_id_key"),
        (5, "R9_profile_path", "fleet[1].profile")}
