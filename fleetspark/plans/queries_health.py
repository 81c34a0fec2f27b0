"""Registered fleet-health queries (P10-P14, P24, P26, J5-J11, A18-A21, U1, T-1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..fixed import PROJECT, PROVIDER_LABEL
from ..functions.core import floor_minutes, queue_wait_secs, sandbox_age_secs
from ..functions.labels import fleet_sandbox, label_map
from ..operators import alerts as al
from ..operators import demand as dm
from ..operators import health as hl
from ..sources.fixtures import ORDERS_AS_OF, fixture, oracle_with
from .queries_demand import classes_df, jobs_df

OWNER = "ACME"
GROUP = "ci-runners"
INSTANCE = "inst-0"
SANDBOX_ORG = "ORG-1"
REPO_FLEET = "f1"
STUCK_AFTER = 30 * 24 * 3600
OLD_AFTER = 365 * 24 * 3600
MAX_SANDBOXES = 100
REALERT = 3600
AS_OF_EPOCH = 915148800.0  # 1999-01-01T00:00:00Z


def visible(spark, sf, private_only=False):
    return hl.lower_key_roster(hl.normalize_roster(fixture(spark, sf, "fx_repos"), OWNER, private_only))


def group_roster(spark, sf):
    return hl.lower_key_roster(fixture(spark, sf, "fx_group_repos"))


def sandboxes(spark, sf):
    s = fixture(spark, sf, "fx_sandbox_inventory")
    return s.select("sandbox_id", "sandbox_no", "created_at",
                    label_map(role=F.col("role"), org=F.col("org"), scope=F.col("scope"),
                              fleet=F.col("fleet")).alias("labels"))


def runners(spark, sf):
    r = fixture(spark, sf, "fx_runners")
    return r.withColumn("labels", F.transform(F.split("labels", ","), lambda x: F.struct(x.alias("name"))))


def live_sandbox_ids(spark, sf):
    return fixture(spark, sf, "fx_registry").select(
        F.concat(F.lit("sbx-"), F.col("sandbox_no").cast("string")).alias("sandbox_id"))


_VIS = "vis AS (SELECT lower(name) AS key, any_value(name) AS name, bool_or(private) AS private FROM fx_repos WHERE lower(owner_login) = 'acme' GROUP BY 1)"
_VISP = "visp AS (SELECT lower(name) AS key, any_value(name) AS name FROM fx_repos WHERE lower(owner_login) = 'acme' AND private GROUP BY 1)"
_GRP = "grp AS (SELECT lower(name) AS key, any_value(name) AS name FROM fx_group_repos GROUP BY 1)"
_SBX = """sb AS (SELECT sandbox_id, sandbox_no, created_at, role, org, scope, fleet FROM fx_sandbox_inventory)"""
_AGE = """CASE WHEN regexp_matches(created_at, '(Z|[+-]\\d{2}:?\\d{2})$')
          THEN epoch(TIMESTAMPTZ '1999-01-01 00:00:00+00') - epoch(TRY_CAST(created_at AS TIMESTAMPTZ)) END"""
_ORGSB = "(role = 'gha-runner' AND org = 'org-1' AND coalesce(scope, '') <> 'repository')"
_REPOSB = "(role = 'gha-runner' AND scope = 'repository' AND fleet = 'f1')"

register("normalize_roster", oracle_with(["fx_repos"], """
SELECT name, private FROM fx_repos WHERE lower(owner_login) = 'acme'
"""))(lambda spark, sf: hl.normalize_roster(fixture(spark, sf, "fx_repos"), OWNER).select("name", "private"))

register("normalize_roster_private", oracle_with(["fx_repos"], """
SELECT name FROM fx_repos WHERE lower(owner_login) = 'acme' AND private IS TRUE
"""))(lambda spark, sf: hl.normalize_roster(fixture(spark, sf, "fx_repos"), OWNER, True).select("name"))

register("lower_key_roster", oracle_with(["fx_group_repos"], f", {_GRP} SELECT key, name FROM grp"))(
    lambda spark, sf: group_roster(spark, sf))

register("selected_not_visible", oracle_with(["fx_repos", "fx_group_repos"], f"""
, {_VIS}, {_GRP} SELECT key, name FROM grp ANTI JOIN vis USING (key)
"""))(lambda spark, sf: hl.selected_not_visible(group_roster(spark, sf), visible(spark, sf)).select("key", "name"))

register("private_uncovered", oracle_with(["fx_repos", "fx_group_repos"], f"""
, {_VISP}, {_GRP} SELECT key, name FROM visp ANTI JOIN grp USING (key)
"""))(lambda spark, sf: hl.private_uncovered(visible(spark, sf, True), group_roster(spark, sf)).select("key", "name"))


def _configured(spark, sf):
    return hl.lower_key_roster(fixture(spark, sf, "fx_configured_repos").withColumnRenamed("repository", "name"))


register("profile_roster_diff", oracle_with(["fx_repos", "fx_configured_repos"], f"""
, {_VISP}, cfg AS (SELECT lower(repository) AS key, any_value(repository) AS name FROM fx_configured_repos GROUP BY 1)
SELECT 'missing' AS kind, key, name FROM cfg ANTI JOIN visp USING (key)
UNION ALL SELECT 'unconfigured' AS kind, key, name FROM visp ANTI JOIN cfg USING (key)
"""))(lambda spark, sf: hl.profile_roster_diff(_configured(spark, sf), visible(spark, sf, True)))

_T_SNV = f"[{INSTANCE}] runner group '{GROUP}' selects repository/repositories not visible to the {PROJECT.app_name}: %s"
_T_UNC = f"[{INSTANCE}] private organization repository/repositories cannot reach runner group '{GROUP}': %s"


def _roster_findings(spark, sf):
    snv = hl.selected_not_visible(group_roster(spark, sf), visible(spark, sf))
    unc = hl.private_uncovered(visible(spark, sf, True), group_roster(spark, sf))
    return (hl.roster_finding(snv, INSTANCE, "selected_not_visible", _T_SNV)
            .unionByName(hl.roster_finding(unc, INSTANCE, "private_uncovered", _T_UNC)))


_ROSTER_SQL = f"""
, {_VIS}, {_VISP}, {_GRP},
snv AS (SELECT name FROM grp ANTI JOIN vis USING (key)),
unc AS (SELECT name FROM visp ANTI JOIN grp USING (key)),
rf AS (
  SELECT '{INSTANCE}' AS instance, 'selected_not_visible' AS "check", '' AS entity,
         replace('{_T_SNV.replace("'", "''")}', '%s', (SELECT string_agg(name, ', ' ORDER BY name) FROM (SELECT name FROM snv ORDER BY name LIMIT 10))) AS text
  WHERE EXISTS (SELECT 1 FROM snv)
  UNION ALL
  SELECT '{INSTANCE}', 'private_uncovered', '',
         replace('{_T_UNC.replace("'", "''")}', '%s', (SELECT string_agg(name, ', ' ORDER BY name) FROM (SELECT name FROM unc ORDER BY name LIMIT 10)))
  WHERE EXISTS (SELECT 1 FROM unc))
"""

register("message_join", oracle_with(["fx_repos", "fx_group_repos"], _ROSTER_SQL + "SELECT * FROM rf"))(_roster_findings)

register("fleet_sandbox", oracle_with(["fx_sandbox_inventory"], f"""
, {_SBX} SELECT sandbox_id, coalesce({_ORGSB}, false) AS org_fleet, coalesce({_REPOSB}, false) AS repo_fleet FROM sb
"""))(lambda spark, sf: sandboxes(spark, sf).select(
    "sandbox_id", fleet_sandbox(F.col("labels"), "organization", SANDBOX_ORG, "").alias("org_fleet"),
    fleet_sandbox(F.col("labels"), "repository", "", REPO_FLEET).alias("repo_fleet")))

register("sandbox_age", oracle_with(["fx_sandbox_inventory"], f"""
SELECT sandbox_id, {_AGE} AS age_secs FROM fx_sandbox_inventory
"""))(lambda spark, sf: fixture(spark, sf, "fx_sandbox_inventory").select(
    "sandbox_id", sandbox_age_secs("created_at", ORDERS_AS_OF).alias("age_secs")))

_LIVE_SB = "live AS (SELECT 'sbx-' || CAST(sandbox_no AS STRING) AS sandbox_id FROM fx_registry)"

register("orphan_sandboxes", oracle_with(["fx_sandbox_inventory", "fx_registry"], f"""
, {_SBX}, {_LIVE_SB}
SELECT sandbox_id, age_secs FROM (SELECT sandbox_id, {_AGE} AS age_secs FROM sb WHERE {_ORGSB}
       AND sandbox_id NOT IN (SELECT sandbox_id FROM live)) x WHERE age_secs IS NULL OR age_secs >= 180
"""))(lambda spark, sf: hl.orphan_sandboxes(sandboxes(spark, sf), live_sandbox_ids(spark, sf), ORDERS_AS_OF,
                                            "organization", SANDBOX_ORG, "").select("sandbox_id", "age_secs"))

register("orphan_sandboxes_repo", oracle_with(["fx_sandbox_inventory", "fx_registry"], f"""
, {_SBX}, {_LIVE_SB}
SELECT sandbox_id, age_secs FROM (SELECT sandbox_id, {_AGE} AS age_secs FROM sb WHERE {_REPOSB}
       AND sandbox_id NOT IN (SELECT sandbox_id FROM live)) x WHERE age_secs IS NULL OR age_secs >= 180
"""))(lambda spark, sf: hl.orphan_sandboxes(sandboxes(spark, sf), live_sandbox_ids(spark, sf), ORDERS_AS_OF,
                                            "repository", "", REPO_FLEET).select("sandbox_id", "age_secs"))

_STALE = (f"status = 'offline' AND starts_with(name, '{PROJECT.runner_name_prefix}') "
          f"AND list_contains(string_split(labels, ','), '{PROVIDER_LABEL}')")
_FLEET_RUNNER = f"list_contains(string_split(labels, ','), '{PROJECT.fleet_label_prefix}{REPO_FLEET}')"

register("orphan_runners", oracle_with(["fx_runners", "fx_registry"], f"""
SELECT runner_id, repository FROM fx_runners u WHERE {_STALE} AND {_FLEET_RUNNER}
  AND NOT EXISTS (SELECT 1 FROM fx_registry g WHERE g.runner_id IS NOT DISTINCT FROM u.runner_id
                  AND g.repository IS NOT DISTINCT FROM u.repository)
"""))(lambda spark, sf: hl.orphan_runners(runners(spark, sf), fixture(spark, sf, "fx_registry"),
                                          "repository", REPO_FLEET).select("runner_id", "repository"))

register("orphan_runners_org", oracle_with(["fx_runners", "fx_registry"], f"""
SELECT runner_id, repository FROM fx_runners u WHERE {_STALE}
  AND NOT EXISTS (SELECT 1 FROM fx_registry g WHERE g.runner_id IS NOT DISTINCT FROM u.runner_id
                  AND g.repository IS NOT DISTINCT FROM u.repository)
"""))(lambda spark, sf: hl.orphan_runners(runners(spark, sf), fixture(spark, sf, "fx_registry"),
                                          "organization", "").select("runner_id", "repository"))

register("reap_candidates", oracle_with(["fx_runners", "fx_sandbox_inventory"], f"""
, {_SBX}
SELECT 'runner' AS kind, CAST(runner_id AS STRING) AS id FROM fx_runners WHERE {_STALE} AND {_FLEET_RUNNER}
UNION ALL SELECT 'sandbox' AS kind, sandbox_id AS id FROM sb WHERE {_REPOSB}
"""))(lambda spark, sf: hl.reap_candidates(runners(spark, sf), sandboxes(spark, sf), "repository", "", REPO_FLEET))

register("queue_wait", oracle_with(["fx_jobs"], f"""
SELECT job_id, epoch(TIMESTAMP '{ORDERS_AS_OF}') - epoch(created_at) AS wait_secs,
       CAST(floor((epoch(TIMESTAMP '{ORDERS_AS_OF}') - epoch(created_at)) / 60) AS BIGINT) AS wait_minutes FROM fx_jobs
"""))(lambda spark, sf: fixture(spark, sf, "fx_jobs").select(
    "job_id", queue_wait_secs("created_at", ORDERS_AS_OF).alias("wait_secs"),
    floor_minutes(queue_wait_secs("created_at", ORDERS_AS_OF)).alias("wait_minutes")))


def _stuck(spark, sf):
    q = dm.queued_jobs(fixture(spark, sf, "fx_runs"), jobs_df(spark, sf))
    return hl.stuck_jobs(q, classes_df(spark, sf), group_roster(spark, sf), ORDERS_AS_OF, STUCK_AFTER,
                         "organization", OWNER, GROUP, INSTANCE)


_STUCK_SQL = f"""
, {_GRP},
j AS (SELECT job_id, run_id, repository, status, string_split(labels, ',') AS jl, created_at FROM fx_jobs),
c AS (SELECT class_pos, name, string_split(labels, ',') AS cl FROM fx_size_classes),
q AS (SELECT row_number() OVER () AS qid, j.* FROM fx_runs r JOIN j ON r.repository = j.repository AND r.run_id = j.run_id
      WHERE r.status IN ('queued', 'in_progress') AND j.status = 'queued'),
m AS (SELECT q.qid, any_value(q.job_id) AS job_id, any_value(q.repository) AS repository, any_value(q.created_at) AS created_at,
             arg_min(c.name, len(c.cl) * 1000 + c.class_pos) AS size_class
      FROM q JOIN c ON len(q.jl) > 0 AND list_has_all(c.cl, q.jl) GROUP BY q.qid),
w AS (SELECT *, epoch(TIMESTAMP '{ORDERS_AS_OF}') - epoch(created_at) AS waited FROM m),
st AS (SELECT w.job_id, w.repository, w.size_class,
              CASE WHEN grp.key IS NULL THEN 'never_reachable' ELSE 'waiting' END AS kind,
              CAST(floor(waited / 60) AS BIGINT) AS minutes
       FROM w LEFT JOIN grp ON grp.key = lower(w.repository) WHERE waited >= {STUCK_AFTER}),
stuck AS (SELECT *, CASE WHEN kind = 'never_reachable'
              THEN '[{INSTANCE}] {OWNER}/' || repository || ': job queued ' || minutes || 'm but the repo is NOT in runner group ''{GROUP}'' — jobs will queue forever until it is added'
              ELSE '[{INSTANCE}] {OWNER}/' || repository || ': job queued ' || minutes || 'm — ' END AS text FROM st)
"""

register("stuck_jobs", oracle_with(["fx_jobs", "fx_runs", "fx_size_classes", "fx_group_repos"],
                                   _STUCK_SQL + "SELECT * FROM stuck"))(_stuck)

register("sandbox_cap", oracle_with(["fx_sandbox_inventory"], f"""
, {_SBX} SELECT '{INSTANCE}' AS instance, 'sandbox_cap' AS "check", '' AS entity,
  '[{INSTANCE}] ' || count(*) || ' fleet-labeled sandboxes exceed the configured max of {MAX_SANDBOXES}' AS text
FROM sb WHERE {_ORGSB} HAVING count(*) > {MAX_SANDBOXES}
"""))(lambda spark, sf: hl.sandbox_cap(sandboxes(spark, sf), MAX_SANDBOXES, "organization", SANDBOX_ORG, "", INSTANCE))

_OLD_SQL = f"""
, {_SBX}, old AS (SELECT sandbox_id FROM sb WHERE {_ORGSB} AND coalesce({_AGE}, 0) > {OLD_AFTER}),
oldf AS (SELECT '{INSTANCE}' AS instance, 'old_sandboxes' AS "check", '' AS entity,
  '[{INSTANCE}] ' || (SELECT count(*) FROM old) || ' sandbox(es) older than {OLD_AFTER // 60}m still running — possible orphans: '
  || (SELECT string_agg(substr(sandbox_id, 1, 8), ', ' ORDER BY sandbox_id) FROM (SELECT sandbox_id FROM old ORDER BY sandbox_id LIMIT 5)) AS text
  WHERE EXISTS (SELECT 1 FROM old))
"""

register("old_sandboxes", oracle_with(["fx_sandbox_inventory"], _OLD_SQL + "SELECT * FROM oldf"))(
    lambda spark, sf: hl.old_sandboxes(sandboxes(spark, sf), ORDERS_AS_OF, OLD_AFTER, "organization", SANDBOX_ORG, "",
                                       INSTANCE))

register("group_id_consistency", oracle_with(["fx_repo_groups"], f"""
, pr AS (SELECT r.repository, coalesce(m.matches, 0) AS matches FROM (SELECT DISTINCT repository FROM fx_repo_groups) r
         LEFT JOIN (SELECT repository, count(*) AS matches FROM fx_repo_groups WHERE group_name = '{GROUP}'
                    AND group_id IS NOT NULL GROUP BY repository) m USING (repository)),
ids AS (SELECT count(DISTINCT group_id) AS distinct_ids FROM fx_repo_groups WHERE group_name = '{GROUP}'
        AND group_id IS NOT NULL AND repository IN (SELECT repository FROM pr WHERE matches = 1))
SELECT repository, matches, matches = 1 AS ok, distinct_ids FROM pr, ids
"""))(lambda spark, sf: hl.group_id_consistency(fixture(spark, sf, "fx_repo_groups"), GROUP))

register("group_selection_check", oracle_with(["fx_runner_groups", "fx_group_repos", "fx_repos"], f"""
, g AS (SELECT * FROM fx_runner_groups WHERE name = '{GROUP}' ORDER BY id NULLS LAST LIMIT 1)
SELECT 'R25_group' AS rule_id, '{GROUP}' AS detail
  WHERE NOT EXISTS (SELECT 1 FROM g WHERE visibility = 'selected' AND allows_public_repositories = false)
UNION ALL SELECT 'R25_no_repositories', '{GROUP}' WHERE NOT EXISTS (SELECT 1 FROM fx_group_repos)
UNION ALL SELECT 'R25_not_visible', name FROM fx_group_repos WHERE lower(name) NOT IN (SELECT lower(name) FROM fx_repos)
"""))(lambda spark, sf: hl.group_selection_check(
    fixture(spark, sf, "fx_runner_groups"), fixture(spark, sf, "fx_group_repos"),
    fixture(spark, sf, "fx_repos").select(F.lower("name").alias("key")), GROUP))

register("group_id_available", oracle_with(["fx_repo_groups"], """
SELECT repository, bool_or(coalesce(group_id = 2, false)) AS ok FROM fx_repo_groups GROUP BY repository
"""))(lambda spark, sf: hl.group_id_available(fixture(spark, sf, "fx_repo_groups"), 2))

register("instance_findings", oracle_with(["fx_instances"], """
SELECT instance, 'unit' AS "check", unit AS entity, '[' || instance || '] systemd unit ' || unit || ' is NOT active' AS text
FROM fx_instances WHERE coalesce(unit, '') <> '' AND NOT coalesce(active, false)
UNION ALL SELECT instance, 'installation', '', '[' || instance || '] the app installation does not cover all repositories'
FROM fx_instances WHERE (coalesce(unit, '') = '' OR coalesce(active, false)) AND scope = 'organization'
  AND coalesce(repository_selection, '') <> 'all'
"""))(lambda spark, sf: hl.all_findings(
    hl.inactive_units(fixture(spark, sf, "fx_instances")),
    hl.installation_findings(hl.active_instances(fixture(spark, sf, "fx_instances")))))

register("selected_group_check", oracle_with(["fx_runner_groups"], """
SELECT name, count(*) AS matches,
       count(*) = 1 AND bool_and(id IS NOT NULL AND visibility = 'selected' AND coalesce(allows_public_repositories = false, false)) AS ok
FROM fx_runner_groups WHERE name IS NOT NULL GROUP BY name
"""))(lambda spark, sf: hl.selected_group_check(fixture(spark, sf, "fx_runner_groups")))


def _findings(spark, sf):
    stuck = _stuck(spark, sf).select(F.lit(INSTANCE).alias("instance"), F.col("kind").alias("check"),
                                     F.col("job_id").cast("string").alias("entity"), "text")
    return hl.all_findings(
        _roster_findings(spark, sf), stuck,
        hl.sandbox_cap(sandboxes(spark, sf), MAX_SANDBOXES, "organization", SANDBOX_ORG, "", INSTANCE),
        hl.old_sandboxes(sandboxes(spark, sf), ORDERS_AS_OF, OLD_AFTER, "organization", SANDBOX_ORG, "", INSTANCE))


_FINDINGS_SQL = (_ROSTER_SQL + _STUCK_SQL.replace(f", {_GRP},", ",", 1) + _OLD_SQL.replace(f", {_SBX},", f", {_SBX},", 1)
                 + f""",
cap AS (SELECT '{INSTANCE}' AS instance, 'sandbox_cap' AS "check", '' AS entity,
  '[{INSTANCE}] ' || count(*) || ' fleet-labeled sandboxes exceed the configured max of {MAX_SANDBOXES}' AS text
  FROM sb WHERE {_ORGSB} HAVING count(*) > {MAX_SANDBOXES}),
fnd AS (SELECT * FROM rf UNION ALL SELECT '{INSTANCE}', kind, CAST(job_id AS STRING), text FROM stuck
        UNION ALL SELECT * FROM cap UNION ALL SELECT * FROM oldf)
""")
_FINDINGS_VIEWS = ["fx_repos", "fx_group_repos", "fx_jobs", "fx_runs", "fx_size_classes", "fx_sandbox_inventory"]

register("all_findings", oracle_with(_FINDINGS_VIEWS, _FINDINGS_SQL + "SELECT * FROM fnd"))(_findings)


def _transitions(spark, sf):
    f = _findings(spark, sf)
    cur = f.select(F.concat_ws("|", "instance", "check", "entity").alias("key"), "text")
    # saved state of the previous pass: one key per job, some alerted within the re-alert period, a third under an old key
    key = F.concat_ws("|", F.lit(INSTANCE), F.lit("waiting"), F.col("job_id").cast("string"))
    prev = fixture(spark, sf, "fx_jobs").select(
        F.when(F.col("job_id") % 3 == 0, F.concat(key, F.lit("-old"))).otherwise(key).alias("key"),
        (F.lit(AS_OF_EPOCH) - (F.col("job_id") % 120) * 60).cast("double").alias("last_alert")).dropDuplicates(["key"])
    return al.alert_transitions(cur.dropDuplicates(["key"]), prev, AS_OF_EPOCH, REALERT)


_TRANSITIONS_SQL = _FINDINGS_SQL + f""",
cur AS (SELECT DISTINCT ON (key) instance || '|' || "check" || '|' || entity AS key, text FROM fnd ORDER BY key),
prev AS (SELECT DISTINCT '{INSTANCE}|waiting|' || CAST(job_id AS STRING) || CASE WHEN job_id % 3 = 0 THEN '-old' ELSE '' END AS key,
                CAST({AS_OF_EPOCH} - (job_id % 120) * 60 AS DOUBLE) AS last_alert FROM fx_jobs),
tr AS (
SELECT coalesce(cur.key, prev.key) AS key, cur.text,
       CASE WHEN cur.key IS NULL THEN 'recovered'
            WHEN {AS_OF_EPOCH} - coalesce(prev.last_alert, 0) >= {REALERT} THEN 'fresh' ELSE 'suppressed' END AS status,
       CASE WHEN cur.key IS NULL THEN NULL
            WHEN {AS_OF_EPOCH} - coalesce(prev.last_alert, 0) >= {REALERT} THEN {AS_OF_EPOCH} ELSE prev.last_alert END AS last_alert
FROM cur FULL OUTER JOIN prev ON cur.key = prev.key)
"""

register("alert_transitions", oracle_with(_FINDINGS_VIEWS, _TRANSITIONS_SQL + "SELECT * FROM tr"))(_transitions)

register("alert_message", oracle_with(_FINDINGS_VIEWS, _TRANSITIONS_SQL + """
SELECT count(*) AS findings, count(*) FILTER (status = 'fresh') AS fresh,
       left(string_agg(text, chr(10) ORDER BY key), 3500) AS body
FROM tr WHERE status <> 'recovered' HAVING count(*) FILTER (status = 'fresh') > 0
"""))(lambda spark, sf: al.alert_message(_transitions(spark, sf)))

register("recovered_message", oracle_with(_FINDINGS_VIEWS, _TRANSITIONS_SQL + """
SELECT count(*) AS recovered, left(string_agg(key, chr(10) ORDER BY key), 3500) AS body
FROM tr WHERE status = 'recovered' HAVING count(*) > 0
"""))(lambda spark, sf: al.recovered_message(_transitions(spark, sf)))


def _queue_wait_text(spark, sf):
    jobs = fixture(spark, sf, "fx_jobs")
    text = F.when(F.col("job_id") % 17 == 0, F.lit("unknown")).otherwise(
        F.concat(F.regexp_replace(F.col("created_at").cast("string"), " ", "T"), F.lit("Z")))
    w = queue_wait_secs(text, ORDERS_AS_OF, text=True)
    return jobs.select("job_id", w.alias("wait_secs")).filter(F.col("wait_secs").isNotNull())


register("queue_wait_text", oracle_with(["fx_jobs"], f"""
SELECT job_id, epoch(TIMESTAMP '{ORDERS_AS_OF}') - epoch(strptime(replace(CAST(created_at AS VARCHAR), ' ', 'T') || 'Z',
       '%Y-%m-%dT%H:%M:%SZ')) AS wait_secs FROM fx_jobs WHERE job_id % 17 <> 0
"""))(_queue_wait_text)


def _repo_findings(spark, sf):
    configured = hl.lower_key_roster(fixture(spark, sf, "fx_configured_repos").withColumnRenamed("repository", "name"))
    return hl.repo_scope_findings(configured, visible(spark, sf, True), fixture(spark, sf, "fx_repo_groups"),
                                  GROUP, INSTANCE, OWNER)


_T_MISS = f"[{INSTANCE}] repository profile includes private App repository/repositories no longer visible: %s"
_T_EXTRA = f"[{INSTANCE}] private App repository/repositories are not covered by this repository profile: %s"


def _top10(src: str) -> str:
    return f"(SELECT string_agg(name, ', ' ORDER BY name) FROM (SELECT name FROM {src} ORDER BY name LIMIT 10))"


register("repo_scope_findings", oracle_with(["fx_repos", "fx_configured_repos", "fx_repo_groups"], f"""
, {_VISP}, cfg AS (SELECT lower(repository) AS key, any_value(repository) AS name FROM fx_configured_repos GROUP BY 1),
miss AS (SELECT name FROM cfg ANTI JOIN visp USING (key)),
extra AS (SELECT name FROM visp ANTI JOIN cfg USING (key)),
rg AS (SELECT * FROM fx_repo_groups WHERE repository IN (SELECT name FROM cfg)),
pr AS (SELECT r.repository, coalesce(m.matches, 0) AS matches FROM (SELECT DISTINCT repository FROM rg) r
       LEFT JOIN (SELECT repository, count(*) AS matches FROM rg WHERE group_name = '{GROUP}' AND group_id IS NOT NULL
                  GROUP BY repository) m USING (repository)),
ids AS (SELECT count(DISTINCT group_id) AS d FROM rg WHERE group_name = '{GROUP}' AND group_id IS NOT NULL
        AND repository IN (SELECT repository FROM pr WHERE matches = 1))
SELECT '{INSTANCE}' AS instance, 'profile_missing' AS "check", '' AS entity,
       replace('{_T_MISS}', '%s', {_top10('miss')}) AS text WHERE EXISTS (SELECT 1 FROM miss)
UNION ALL SELECT '{INSTANCE}', 'profile_unconfigured', '', replace('{_T_EXTRA}', '%s', {_top10('extra')})
  WHERE EXISTS (SELECT 1 FROM extra)
UNION ALL SELECT '{INSTANCE}', 'group_unavailable', repository,
  '[{INSTANCE}] configured runner group ''{GROUP}'' is unavailable to {OWNER}/' || repository FROM pr WHERE matches <> 1
UNION ALL SELECT '{INSTANCE}', 'group_inconsistent', '',
  '[{INSTANCE}] configured runner group ''{GROUP}'' has inconsistent IDs across repositories' FROM ids WHERE d > 1
"""))(_repo_findings)
