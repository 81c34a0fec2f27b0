"""Registered demand / plan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import demand as dm
from ..operators import labels as lb
from ..sources.fixtures import fixture, oracle_with

IDLE_REFRESH_SECS = 1800
DEMAND_IDLE_SECS = 300


def jobs_df(spark, sf):
    return fixture(spark, sf, "fx_jobs").withColumn("labels", F.split("labels", ","))


def classes_df(spark, sf, view="fx_size_classes"):
    return fixture(spark, sf, view).withColumn("labels", F.split("labels", ","))


def queued_df(spark, sf):
    return dm.queued_jobs(fixture(spark, sf, "fx_runs"), jobs_df(spark, sf))


def registry_busy_df(spark, sf):
    return dm.busy_lookup(fixture(spark, sf, "fx_registry"), fixture(spark, sf, "fx_runners"))


_J = "j AS (SELECT job_id, run_id, repository, status, string_split(labels, ',') AS jl FROM fx_jobs)"
_C = "c AS (SELECT class_pos, name, string_split(labels, ',') AS cl, min_idle, max_live FROM fx_size_classes)"
_CF = _C.replace("FROM fx_size_classes", "FROM fx_size_classes_fleet")
_Q = """q AS (SELECT row_number() OVER () AS qid, r.repository, r.run_id, j.job_id, j.jl FROM fx_runs r JOIN j
              ON r.repository = j.repository AND r.run_id = j.run_id
              WHERE r.status IN ('queued', 'in_progress') AND j.status = 'queued')"""
_M = """m AS (SELECT q.qid, q.repository, q.job_id, arg_min(c.name, len(c.cl) * 1000 + c.class_pos) AS size_class
              FROM q JOIN c ON len(q.jl) > 0 AND list_has_all(c.cl, q.jl) GROUP BY ALL)"""
_RB = """rb AS (SELECT g.*, coalesce(u.busy, false) AS busy FROM fx_registry g LEFT JOIN fx_runners u
               ON g.runner_id IS NOT DISTINCT FROM u.runner_id AND g.repository IS NOT DISTINCT FROM u.repository)"""
_SUP = "(state = 'SPAWNING' OR (state = 'IDLE' AND NOT busy))"

register("required_labels_filter", oracle_with(["fx_jobs"], f"""
, {_J} SELECT job_id FROM j WHERE list_has_all(jl, ['self-hosted'])
"""))(lambda spark, sf: lb.required_labels_filter(jobs_df(spark, sf), ["self-hosted"]).select("job_id"))

register("match_class", oracle_with(["fx_jobs", "fx_size_classes"], f"""
, {_J}, {_C}
SELECT j.job_id, arg_min(c.name, len(c.cl) * 1000 + c.class_pos) AS size_class
FROM j LEFT JOIN c ON len(j.jl) > 0 AND list_has_all(c.cl, j.jl) GROUP BY j.job_id
"""))(lambda spark, sf: lb.match_class(jobs_df(spark, sf), classes_df(spark, sf)).select("job_id", "size_class"))

register("match_class_required", oracle_with(["fx_jobs", "fx_size_classes"], f"""
, {_J}, {_C}
SELECT j.job_id, arg_min(c.name, len(c.cl) * 1000 + c.class_pos) AS size_class
FROM j LEFT JOIN c ON len(j.jl) > 0 AND list_has_all(c.cl, j.jl) AND list_has_all(j.jl, ['ci'])
GROUP BY j.job_id
"""))(lambda spark, sf: lb.match_class(jobs_df(spark, sf), classes_df(spark, sf), required=["ci"])
      .select("job_id", "size_class"))

register("webhook_labels_match", oracle_with(["fx_deliveries", "fx_size_classes"], f"""
, {_C}, d AS (SELECT event_id, list_filter(string_split(labels, ','), lambda x: x <> '') AS dl FROM fx_deliveries)
SELECT event_id, EXISTS (SELECT 1 FROM c WHERE len(d.dl) > 0 AND list_has_all(d.dl, c.cl)) AS labels_match FROM d
"""))(lambda spark, sf: lb.webhook_labels_match(
    fixture(spark, sf, "fx_deliveries").withColumn("labels", F.split("labels", ",")),
    classes_df(spark, sf)).select("event_id", "labels_match"))

register("queued_jobs", oracle_with(["fx_jobs", "fx_runs"], f"""
, {_J}, {_Q} SELECT repository, run_id, job_id FROM q
"""))(lambda spark, sf: queued_df(spark, sf).select("repository", "run_id", "job_id"))

register("busy_lookup", oracle_with(["fx_registry", "fx_runners"], f"""
, {_RB} SELECT cycle_id, repository, state, busy FROM rb
"""))(lambda spark, sf: registry_busy_df(spark, sf).select("cycle_id", "repository", "state", "busy"))

register("demand_by_class", oracle_with(["fx_jobs", "fx_runs", "fx_size_classes"], f"""
, {_J}, {_C}, {_Q}, {_M}
SELECT c.name AS size_class, (SELECT count(*) FROM m WHERE m.size_class = c.name) AS queued FROM c
"""))(lambda spark, sf: dm.demand_by_class(queued_df(spark, sf), classes_df(spark, sf)))

register("demand_by_repo_class", oracle_with(["fx_jobs", "fx_runs", "fx_size_classes", "fx_configured_repos"], f"""
, {_J}, {_C}, {_Q}, {_M}
SELECT r.repository, c.name AS size_class,
       (SELECT count(*) FROM m WHERE m.size_class = c.name AND m.repository = r.repository) AS queued
FROM fx_configured_repos r, c
"""))(lambda spark, sf: dm.demand_by_repo_class(queued_df(spark, sf), classes_df(spark, sf),
                                                fixture(spark, sf, "fx_configured_repos")))

register("supply_and_live", oracle_with(["fx_registry", "fx_runners"], f"""
, {_RB} SELECT cls_name AS size_class, count(*) FILTER (WHERE {_SUP}) AS supply, count(*) AS live
FROM rb GROUP BY cls_name
"""))(lambda spark, sf: dm.supply_and_live(registry_busy_df(spark, sf)))

register("supply_and_live_repo", oracle_with(["fx_registry", "fx_runners"], f"""
, {_RB} SELECT repository, cls_name AS size_class, count(*) FILTER (WHERE {_SUP}) AS supply, count(*) AS live
FROM rb GROUP BY repository, cls_name
"""))(lambda spark, sf: dm.supply_and_live(registry_busy_df(spark, sf), by_repo=True))

register("registry_status", oracle_with(["fx_registry"], """
SELECT cls_name, count(*) AS total, count(*) FILTER (WHERE state = 'BUSY') AS busy FROM fx_registry GROUP BY cls_name
"""))(lambda spark, sf: dm.registry_status(fixture(spark, sf, "fx_registry"), ["cls_name"]))

_PLAN_ORG = f"""
, {_J}, {_CF}, {_Q}, {_M}, {_RB},
d AS (SELECT c.name AS size_class, (SELECT count(*) FROM m WHERE m.size_class = c.name) AS queued FROM c),
s AS (SELECT cls_name AS size_class, count(*) FILTER (WHERE {_SUP}) AS supply, count(*) AS live FROM rb GROUP BY cls_name),
x AS (SELECT c.name AS size_class, coalesce(d.queued, 0) AS queued, coalesce(s.supply, 0) AS supply,
             coalesce(s.live, 0) AS live, coalesce(c.min_idle, 0) AS min_idle,
             coalesce(CAST(c.max_live AS BIGINT), 1000000000) AS max_live
      FROM c LEFT JOIN d ON d.size_class = c.name LEFT JOIN s ON s.size_class = c.name),
p AS (SELECT *, CAST(least(greatest(queued - supply, min_idle - supply, 0), greatest(max_live - live, 0)) AS BIGINT) AS to_spawn FROM x)
"""


def _plan_org(spark, sf):
    classes = classes_df(spark, sf, "fx_size_classes_fleet")
    return dm.spawn_plan_org(dm.demand_by_class(queued_df(spark, sf), classes),
                             dm.supply_and_live(registry_busy_df(spark, sf)), classes)


register("spawn_plan_org", oracle_with(["fx_jobs", "fx_runs", "fx_size_classes_fleet", "fx_registry", "fx_runners"], f"""
{_PLAN_ORG}
SELECT *, CAST(greatest(least(min_idle - supply, to_spawn), 0) AS BIGINT) AS floor_slots FROM p
"""))(_plan_org)

register("spawn_slots", oracle_with(["fx_jobs", "fx_runs", "fx_size_classes_fleet", "fx_registry", "fx_runners"], f"""
{_PLAN_ORG},
f AS (SELECT *, CAST(greatest(least(min_idle - supply, to_spawn), 0) AS BIGINT) AS floor_slots FROM p WHERE to_spawn > 0)
SELECT size_class, CAST(slot AS BIGINT) AS slot,
       CASE WHEN slot < floor_slots THEN {IDLE_REFRESH_SECS} ELSE {DEMAND_IDLE_SECS} END AS idle_deadline_secs
FROM f, range(0, f.to_spawn) t(slot)
"""))(lambda spark, sf: dm.spawn_slots(_plan_org(spark, sf), IDLE_REFRESH_SECS, DEMAND_IDLE_SECS))


def _plan_repo(spark, sf):
    classes = classes_df(spark, sf, "fx_size_classes_fleet")
    repos = fixture(spark, sf, "fx_configured_repos")
    demand = dm.demand_by_repo_class(queued_df(spark, sf), classes, repos)
    supply = dm.supply_and_live(registry_busy_df(spark, sf), by_repo=True)
    return dm.spawn_plan_repo(demand, supply, classes, repos)


register("spawn_plan_repo", oracle_with(
    ["fx_jobs", "fx_runs", "fx_size_classes_fleet", "fx_registry", "fx_runners", "fx_configured_repos"], f"""
, {_J}, {_CF}, {_Q}, {_M}, {_RB},
d AS (SELECT r.repository, r.repo_pos, c.name AS size_class,
             (SELECT count(*) FROM m WHERE m.size_class = c.name AND m.repository = r.repository) AS queued
      FROM fx_configured_repos r, c),
s AS (SELECT repository, cls_name AS size_class, count(*) FILTER (WHERE {_SUP}) AS supply, count(*) AS live
      FROM rb GROUP BY repository, cls_name),
cl AS (SELECT cls_name AS size_class, count(*) AS class_live FROM rb GROUP BY cls_name),
a AS (SELECT c.name AS size_class,
             greatest(coalesce(CAST(c.max_live AS BIGINT), 1000000000) - coalesce(cl.class_live, 0), 0) AS available
      FROM c LEFT JOIN cl ON cl.size_class = c.name),
x AS (SELECT d.repository, d.repo_pos, d.size_class, d.queued, coalesce(s.supply, 0) AS supply,
             greatest(d.queued - coalesce(s.supply, 0), 0) AS deficit, a.available
      FROM d LEFT JOIN s ON s.repository = d.repository AND s.size_class = d.size_class
      JOIN a ON a.size_class = d.size_class)
SELECT repository, size_class, queued, supply, deficit, available,
       CAST(least(deficit, greatest(available - coalesce(sum(deficit) OVER (PARTITION BY size_class ORDER BY repo_pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS BIGINT) AS to_spawn
FROM x
"""))(_plan_repo)
