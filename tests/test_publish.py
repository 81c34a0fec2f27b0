"""Published audit reports, and policies compared by their canonical bodies."""

import json

import pytest

from fleetspark.operators import config as cf
from fleetspark.plans.audit_report import publish_audit
from fleetspark.session import scratch_path
from fleetspark.sources.report import KEPT_VERSIONS, RejectedReport, published_version, read_published
from fleetspark.sources.state import subfolders


def _item(sid, name):
    return {"id": sid, "name": name, "state": "active", "size": 1, "imageName": "registry.test/x:1", "cpu": 1, "mem": 1, "disk": 1,
            "gpu": 0, "sandboxClass": "small", "regionIds": ["north"], "createdAt": "2023-03-01T00:00:00Z"}


def test_errors_leave_the_published_report(spark):
    base = scratch_path(spark, "publish")
    refs = spark.createDataFrame([("amber", "hill", "hill.toml", "default")], "snapshot string, fleet string, profile string, size_class string")

    def payload(*items):
        return spark.createDataFrame([(json.dumps(list(items)),)], "payload string")

    def names():
        return sorted(json.loads(r.value)["name"] for r in read_published(spark, base, "snapshots").collect())

    with pytest.raises(LookupError):
        read_published(spark, base, "snapshots")
    pages = spark.createDataFrame([(1, 1, 1)], "position long, page long, total_pages long")
    assert publish_audit(payload(_item("s1", "amber")), refs, base, pages=pages) == 1 and names() == ["amber"]
    bad_page = spark.createDataFrame([(1, 1, 2), (2, 3, 2)], "position long, page long, total_pages long")
    with pytest.raises(RejectedReport, match="inventory pages"):
        publish_audit(payload(_item("s1", "birch")), refs, base, pages=bad_page)
    with pytest.raises(RejectedReport, match="more than once"):
        publish_audit(payload(_item("s1", "birch"), _item("s1", "cedar")), refs, base)
    assert published_version(spark, base) == 1 and names() == ["amber"] and subfolders(spark, f"{base}/versions") == ["v=1"]
    for n in range(KEPT_VERSIONS):
        version = publish_audit(payload(_item("s1", "birch"), _item("s2", f"dune{n}")), refs, base)
    assert names() == ["birch", f"dune{KEPT_VERSIONS - 1}"] and published_version(spark, base) == version
    assert len(subfolders(spark, f"{base}/versions")) == KEPT_VERSIONS


def test_policies(spark):
    def df(rows):
        return spark.createDataFrame([(n, t, json.dumps(b)) for n, t, b in rows], "name string, type string, body string")

    nested = {"rules": [{"type": "deletion"}, {"type": "checks", "with": {"strict": True, "names": ["lint", "test"], "n": 1}}], "on": []}
    turned = {"on": [], "rules": [{"with": {"names": ["test", "lint"], "n": 1.0, "strict": True}, "type": "checks"}, {"type": "deletion"}]}
    other = {"on": [], "rules": [{"with": {"names": ["test"], "n": 1, "strict": True}, "type": "checks"}, {"type": "deletion"}]}
    actual = df([("same", "branch", nested), ("body", "branch", nested), ("kind", "branch", nested), ("gone", "tag", {}), ("empty", "tag", {"a": {}})])
    desired = df([("same", "branch", turned), ("body", "branch", other), ("kind", "tag", nested), ("new", "tag", {}), ("empty", "tag", {"a": []})])
    got = {(r.name, r.step): r.action for r in cf.policy_diff(actual, desired).collect()}
    assert got == {("same", 1): "keep", ("body", 1): "update", ("kind", 1): "delete", ("kind", 2): "create", ("gone", 1): "delete",
                   ("new", 1): "create", ("empty", 1): "update"}
