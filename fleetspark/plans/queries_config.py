"""Registered configuration queries (S5, J15-J18, A23, P25, W9, 2.8 rules)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..fixed import PROJECT
from ..functions.labels import base_labels
from ..operators import config as cf
from ..operators import health as hl
from ..operators import rules as rl
from ..sources.fixtures import fixture, oracle_with
from .queries_health import OWNER

GROUP = "ci-runners"

register("flatten_profile_refs", oracle_with(["fx_fleets", "fx_fleet_classes"], """
SELECT c.snapshot, f.fleet, f.profile, c.name AS size_class FROM fx_fleets f JOIN fx_fleet_classes c ON c.profile = f.profile
"""))(lambda spark, sf: cf.flatten_profile_refs(fixture(spark, sf, "fx_fleets"), fixture(spark, sf, "fx_fleet_classes")))

register("target_available", oracle_with(["fx_fleets", "fx_regions"], """
SELECT fleet_pos, fleet, target, EXISTS (SELECT 1 FROM fx_regions r WHERE r.id = f.target OR r.name = f.target) AS available
FROM fx_fleets f
"""))(lambda spark, sf: cf.target_available(fixture(spark, sf, "fx_fleets"), fixture(spark, sf, "fx_regions")))


def _visible(spark, sf):
    repos = hl.normalize_roster(fixture(spark, sf, "fx_repos"), OWNER)
    return repos.groupBy(F.lower("name").alias("key")).agg(F.max_by("private", "name").alias("private"))


register("repo_visibility_check", oracle_with(["fx_configured_repos", "fx_repos", "fx_repo_groups"], f"""
, vis AS (SELECT lower(name) AS k, arg_max(private, name) AS private FROM fx_repos WHERE lower(owner_login) = 'acme' GROUP BY 1),
g AS (SELECT lower(repository) AS gk, count(*) AS matches FROM fx_repo_groups WHERE group_name = '{GROUP}' AND group_id IS NOT NULL GROUP BY 1),
b AS (SELECT c.repository, vis.k, vis.private, coalesce(g.matches, 0) AS matches FROM fx_configured_repos c
      LEFT JOIN vis ON vis.k = lower(c.repository) LEFT JOIN g ON g.gk = lower(c.repository))
SELECT repository, CASE WHEN k IS NULL THEN 'not_visible' WHEN NOT coalesce(private = true, false) THEN 'not_private'
                        ELSE 'group_unavailable' END AS rule,
       CASE WHEN k IS NULL THEN 1 WHEN NOT coalesce(private = true, false) THEN 2 ELSE 3 END AS rule_no
FROM b WHERE k IS NULL OR NOT coalesce(private = true, false) OR matches <> 1
"""))(lambda spark, sf: cf.repo_visibility_check(fixture(spark, sf, "fx_configured_repos"), _visible(spark, sf),
                                                 fixture(spark, sf, "fx_repo_groups"), GROUP))

register("desired_state_diff", oracle_with(["fx_rulesets_actual", "fx_rulesets_desired"], """
SELECT coalesce(a.name, d.name) AS name,
       CASE WHEN a.name IS NULL THEN 'create'
            WHEN d.name IS NULL THEN CASE WHEN a.target = 'branch' AND a.source_type = 'Repository' THEN 'delete' ELSE 'ignore' END
            WHEN a.target IS DISTINCT FROM d.target OR a.enforcement IS DISTINCT FROM d.enforcement THEN 'update'
            ELSE 'keep' END AS action
FROM fx_rulesets_actual a FULL OUTER JOIN fx_rulesets_desired d ON a.name = d.name
"""))(lambda spark, sf: cf.desired_state_diff(
    fixture(spark, sf, "fx_rulesets_actual"), fixture(spark, sf, "fx_rulesets_desired"), "name",
    ["target", "enforcement"], delete_scope=(F.col("target") == "branch") & (F.col("source_type") == "Repository")))

register("policy_diff", oracle_with(["fx_policies_actual", "fx_policies_desired"], """
, j AS (SELECT coalesce(a.name, d.name) AS name, a.name AS an, d.name AS dn, a.type AS ta, d.type AS td,
               regexp_extract(a.body, '"n": ([0-9]+)', 1) AS av, regexp_extract(d.body, '"n": ([0-9]+)', 1) AS dv
        FROM fx_policies_actual a FULL OUTER JOIN fx_policies_desired d ON a.name = d.name)
SELECT name, 1 AS step, CASE WHEN an IS NULL THEN 'create' WHEN dn IS NULL OR ta <> td THEN 'delete'
                             WHEN av <> dv THEN 'update' ELSE 'keep' END AS action FROM j
UNION ALL SELECT name, 2, 'create' FROM j WHERE ta <> td
"""))(lambda spark, sf: cf.policy_diff(fixture(spark, sf, "fx_policies_actual"), fixture(spark, sf, "fx_policies_desired")))

register("volume_lookup", oracle_with(["fx_fleets", "fx_volumes"], """
SELECT f.fleet_pos, f.cache_volume, v.volume_id FROM fx_fleets f
LEFT JOIN (SELECT name, arg_min(id, pos) AS volume_id FROM fx_volumes GROUP BY name) v ON v.name = f.cache_volume
"""))(lambda spark, sf: cf.volume_lookup(fixture(spark, sf, "fx_fleets"), fixture(spark, sf, "fx_volumes"))
      .select("fleet_pos", "cache_volume", "volume_id"))

register("single_api_base", oracle_with(["fx_fleets"], """
SELECT count(DISTINCT regexp_replace(api_base, '/+$', '')) AS distinct_bases,
       count(DISTINCT regexp_replace(api_base, '/+$', '')) = 1 AS ok FROM fx_fleets
"""))(lambda spark, sf: cf.single_api_base(fixture(spark, sf, "fx_fleets")))


def _labels(spark, sf):
    f = fixture(spark, sf, "fx_fleets")
    m = base_labels(F.col("scope"), F.col("owner"), F.col("fleet"), F.col("network_policy"), F.lit("default"),
                    F.when(F.col("scope") == "repository", F.concat(F.lit("repo-"), (F.col("fleet_pos") % 25).cast("string"))))
    return f.select("fleet_pos", F.array_join(F.array_sort(F.transform(
        F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("labels"))


register("base_labels", oracle_with(["fx_fleets"], """
SELECT fleet_pos, array_to_string(list_sort(list_filter([
    'role=gha-runner', 'org=' || lower(owner),
    CASE WHEN scope = 'repository' THEN 'scope=' || scope END,
    CASE WHEN scope = 'repository' THEN 'fleet=' || fleet END,
    CASE WHEN network_policy = 'deny-by-default' THEN 'network_policy=deny-by-default' END,
    'size_class=default',
    CASE WHEN scope = 'repository' THEN 'repository=repo-' || CAST(fleet_pos % 25 AS VARCHAR) END], lambda x: x IS NOT NULL)), ',') AS labels
FROM fx_fleets
"""))(_labels)

# ---------------------------------------------------------------- 2.8 rules oracle


def _full(col: str, pattern: str) -> str:
    return f"coalesce(regexp_full_match({col}, '{pattern.strip('^$')}'), false)"


_TARGET = "[a-z0-9][a-z0-9-]{0,62}"
_DOMAIN = "([*][.])?([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?[.])+[a-z]{2,63}"
_REPOSITORY = "[.]github|[A-Za-z0-9][A-Za-z0-9._-]*"
# private space by first and last address, typed as numbers of 256
_PRIV = """(ip >= 0 AND e < 16777216) OR (ip >= 10::BIGINT * 16777216 AND e < 11::BIGINT * 16777216)
 OR (ip >= 127::BIGINT * 16777216 AND e < 128::BIGINT * 16777216)
 OR (ip >= (169::BIGINT * 256 + 254) * 65536 AND e < (169::BIGINT * 256 + 255) * 65536)
 OR (ip >= (172::BIGINT * 256 + 16) * 65536 AND e < (172::BIGINT * 256 + 32) * 65536)
 OR (ip >= 192::BIGINT * 16777216 AND e < 192::BIGINT * 16777216 + 256)
 OR (ip >= (192::BIGINT * 65536 + 2) * 256 AND e < (192::BIGINT * 65536 + 3) * 256)
 OR (ip >= (192::BIGINT * 256 + 168) * 65536 AND e < (192::BIGINT * 256 + 169) * 65536)
 OR (ip >= (198::BIGINT * 256 + 18) * 65536 AND e < (198::BIGINT * 256 + 20) * 65536)
 OR (ip >= ((198::BIGINT * 256 + 51) * 256 + 100) * 256 AND e < ((198::BIGINT * 256 + 51) * 256 + 101) * 256)
 OR (ip >= (203::BIGINT * 65536 + 113) * 256 AND e < (203::BIGINT * 65536 + 114) * 256)
 OR (ip >= 240::BIGINT * 16777216 AND e < 256::BIGINT * 16777216)"""
_NETS = "list_transform(list_filter(cidrs, lambda c: c.valid), lambda c: c.net)"
_FORM = "([0-9]{1,3})[.]([0-9]{1,3})[.]([0-9]{1,3})[.]([0-9]{1,3})"
_CIDR_SQL = f"""list_transform(string_split(cidr_allow_list, ','), lambda x: {{
    'shaped': regexp_full_match(x, '{_FORM}(/([0-9]+|{_FORM}))?')
              AND NOT regexp_matches(x, '(^|[./])0[0-9]+[.]|[.]0[0-9]+(/|$)') AND NOT regexp_matches(x, '/0*[0-9]{{{{3,}}}}$'),
    'mask': CASE WHEN contains(x, '/') AND contains(split_part(x, '/', 2), '.') THEN
        list_reduce(list_transform(string_split(split_part(x, '/', 2), '.'), lambda o: TRY_CAST(o AS BIGINT)), lambda a, b: a * 256 + b) END,
    'bits': CASE WHEN NOT contains(x, '/') THEN 32 WHEN NOT contains(split_part(x, '/', 2), '.') THEN TRY_CAST(split_part(x, '/', 2) AS BIGINT) END,
    'o': list_transform(string_split(replace(x, '/', '.'), '.'), lambda o: TRY_CAST(o AS BIGINT))}})"""
# every mask of the form ones then zeros, and its inverse
_MASKS = {((1 << 32) - 1) ^ ((1 << (32 - n)) - 1): n for n in range(33)}
_PLEN = ("CASE WHEN e.mask IS NULL THEN e.bits "
         + " ".join(f"WHEN e.mask = {m} THEN {n}" for m, n in _MASKS.items())
         + " " + " ".join(f"WHEN e.mask = {(1 << 32) - 1 - m} THEN {n}" for m, n in _MASKS.items() if 0 < n < 32) + " END")


def cidr_ctes(source: str) -> str:
    """CTEs ending in ``fc``: ``source`` with its comma text ``cidr_allow_list`` judged as ``cidrs``."""
    return f"""
, fr AS (SELECT *, list_transform({_CIDR_SQL}, lambda e: {{
      'shaped': e.shaped AND greatest(e.o[1], e.o[2], e.o[3], e.o[4]) <= 255
                AND (e.mask IS NULL OR greatest(e.o[5], e.o[6], e.o[7], e.o[8]) <= 255),
      'ip': e.o[1] * 16777216 + e.o[2] * 65536 + e.o[3] * 256 + e.o[4], 'p': {_PLEN}}}) AS c0 FROM {source}),
f2 AS (SELECT *, list_transform(c0, lambda e: {{'shaped': e.shaped, 'ip': e.ip, 'p': e.p,
      'sz': CASE WHEN e.p BETWEEN 0 AND 32 THEN 1::BIGINT << (32 - e.p) END}}) AS c1 FROM fr),
fc AS (SELECT *, list_transform(c1, lambda z: {{'valid': coalesce(z.shaped AND z.ip % z.sz = 0, false),
      'net': CAST(z.ip AS VARCHAR) || '/' || CAST(z.p AS VARCHAR),
      'private': coalesce({_PRIV.replace('ip', 'z.ip').replace('e <', 'z.ip + z.sz - 1 <')}, false)}}) AS cidrs FROM f2)"""


def _fleet_rules_sql() -> str:
    isrepo = "scope = 'repository'"
    net = "network_policy IS NOT NULL"
    rules = [
        (2, "R2_fleet_name", f"NOT {_full('fleet', '[a-z0-9][a-z0-9-]*')}"),
        (3, "R3_owner_name", f"NOT {_full('owner', '[A-Za-z0-9][A-Za-z0-9-]*')}"),
        (4, "R4_scope", "scope IS NULL OR scope NOT IN ('organization', 'repository')"),
        (4, "R4_profile_scope", "coalesce(profile_scope, 'organization') IS DISTINCT FROM scope"),
        (6, "R6_owner", "profile_owner IS NULL OR owner IS NULL OR profile_owner <> owner"),
        (6, "R6_org_runner_group", f"scope = 'organization' AND NOT coalesce(runner_group = 'daytona', false)"),
        (7, "R7_repo_group_exactly_one", f"{isrepo} AND ((runner_group IS NULL) = (runner_group_id IS NULL))"),
        (7, "R7_repo_group_id", f"{isrepo} AND runner_group_id IS NOT NULL AND runner_group_id < 1"),
        (7, "R7_repo_group_name", f"{isrepo} AND runner_group IS NOT NULL AND NOT {_full('runner_group', '[a-z0-9][a-z0-9-]*')}"),
        (9, "R9_target", f"NOT {_full('target', _TARGET)}"),
        (10, "R10_network_scope", f"{net} AND NOT {isrepo}"),
        (10, "R10_network_policy", f"{net} AND network_policy <> 'deny-by-default'"),
        (10, "R10_cidr_count", f"{net} AND NOT coalesce(len(cidrs) BETWEEN 1 AND 5, false)"),
        (10, "R10_cidr_invalid", f"{net} AND list_bool_or(list_transform(cidrs, lambda c: NOT c.valid))"),
        (10, "R10_cidr_public", f"{net} AND list_bool_or(list_transform(cidrs, lambda c: c.valid AND NOT c.private))"),
        (10, "R10_cidr_duplicate", f"{net} AND len(list_distinct({_NETS})) <> len({_NETS})"),
        (11, "R11_domains_missing", f"{net} AND (domain_allow_list IS NULL OR domain_allow_list = '')"),
        (11, "R11_domain_invalid", f"{net} AND list_bool_or(list_transform(string_split(domain_allow_list, ','), lambda d: NOT {_full('d', _DOMAIN)}))"),
        (11, "R11_domain_duplicate", f"{net} AND len(list_distinct(list_transform(string_split(domain_allow_list, ','), lambda d: lower(d)))) <> len(string_split(domain_allow_list, ','))"),
        (13, "R13_cache_volume", "cache_volume IS NOT NULL AND trim(cache_volume) = ''"),
        (14, "R14_poll_interval", f"poll_interval_secs < 1 OR ({isrepo} AND poll_interval_secs < 60)"),
        (14, "R14_request_spacing", "request_spacing_secs < 0"),
        (9, "R9_profile_path", "profile IS NULL OR profile = '' OR starts_with(profile, '/') OR contains(profile, '..')"),
        (9, "R9_installation_key", "installation_key IS NULL OR NOT regexp_full_match(installation_key, '[1-9][0-9]*')"),
        (24, "R24_api_base", "api_base <> 'https://app.daytona.io/api'"),
    ]
    body = "\nUNION ALL ".join(
        f"SELECT fleet_pos, fleet, {n} AS rule_no, '{rid}' AS rule_id FROM fc WHERE coalesce({cond}, false)"
        for n, rid, cond in rules)
    return f"""{cidr_ctes('fx_fleets')}
SELECT * FROM (
{body}
UNION ALL SELECT fleet_pos, fleet, 2, 'R2_fleet_unique' FROM fx_fleets WHERE fleet IN (SELECT fleet FROM fx_fleets GROUP BY fleet HAVING count(*) > 1)
UNION ALL SELECT fleet_pos, fleet, 3, 'R3_scope_owner_unique' FROM fx_fleets f
  WHERE (scope, lower(owner)) IN (SELECT (scope, lower(owner)) FROM fx_fleets GROUP BY scope, lower(owner) HAVING count(*) > 1)
UNION ALL SELECT NULL, NULL, 1, 'R1_no_fleet' FROM (SELECT count(*) AS n FROM fx_fleets) WHERE n = 0) v
"""


register("fleet_rule_violations", oracle_with(["fx_fleets"], _fleet_rules_sql()))(
    lambda spark, sf: rl.fleet_rule_violations(fixture(spark, sf, "fx_fleets")))

register("first_failing_rule", oracle_with(["fx_fleets"], _fleet_rules_sql().replace("\nSELECT * FROM (", ",\nallv AS (SELECT * FROM (", 1)
                                           + """)
SELECT fleet_pos, fleet, arg_min(rule_id, struct_pack(n := rule_no, r := rule_id)) AS rule, min(rule_no) AS rule_no FROM allv GROUP BY fleet_pos, fleet
"""))(lambda spark, sf: cf.first_failing_rule(
    rl.fleet_rule_violations(fixture(spark, sf, "fx_fleets")).withColumnRenamed("rule_id", "rule")
    .withColumn("failed", F.lit(True)), ["fleet_pos", "fleet"]))

register("class_rule_violations", oracle_with(["fx_fleet_classes", "fx_fleets"], """
, sc AS (SELECT profile, min(scope) AS scope, any_value(routing_labels) AS routing_labels FROM fx_fleets GROUP BY profile),
j AS (SELECT c.*, sc.scope, sc.routing_labels, coalesce(string_split(c.labels, ','), []) AS l,
             string_split(sc.routing_labels, ',') AS rt FROM fx_fleet_classes c LEFT JOIN sc USING (profile))
SELECT profile, class_pos, name, 18 AS rule_no, 'R18_labels' AS rule_id FROM j
  WHERE NOT list_contains(l, 'self-hosted') OR (routing_labels IS NULL AND NOT list_contains(l, 'daytona'))
UNION ALL SELECT profile, class_pos, name, 18, 'R18_routing_shared' FROM j
  WHERE routing_labels IS NOT NULL AND (list_contains(l, 'daytona') OR list_contains(l, 'cipool'))
UNION ALL SELECT profile, class_pos, name, 18, 'R18_routing_missing' FROM j WHERE routing_labels IS NOT NULL AND NOT list_has_all(l, rt)
UNION ALL SELECT profile, class_pos, name, 19, 'R19_snapshot' FROM j WHERE snapshot IS NULL OR trim(snapshot) = ''
UNION ALL SELECT profile, class_pos, name, 19, 'R19_min_idle' FROM j WHERE min_idle IS NULL OR min_idle < 0
UNION ALL SELECT profile, class_pos, name, 19, 'R19_max' FROM j WHERE max_live IS NULL OR max_live < 0
UNION ALL SELECT profile, class_pos, name, 19, 'R19_min_le_max' FROM j WHERE min_idle > max_live
UNION ALL SELECT profile, class_pos, name, 19, 'R19_repo_min_zero' FROM j WHERE scope = 'repository' AND (min_idle IS NULL OR min_idle <> 0)
UNION ALL SELECT profile, class_pos, name, 20, 'R20_warm_floor_reason' FROM j
  WHERE CASE WHEN coalesce(min_idle, 0) > 0 THEN coalesce(trim(warm_floor_reason), '') = '' ELSE warm_floor_reason IS NOT NULL END
UNION ALL SELECT profile, class_pos, name, 21, 'R21_large_label' FROM j WHERE name = 'large' AND NOT list_contains(l, 'large')
UNION ALL SELECT profile, class_pos, name, 18, 'R18_unique_name' FROM fx_fleet_classes
  WHERE (profile, name) IN (SELECT (profile, name) FROM fx_fleet_classes GROUP BY profile, name HAVING count(*) > 1)
UNION ALL SELECT DISTINCT profile, NULL, NULL, 18, 'R18_no_class' FROM fx_fleets f
  WHERE NOT EXISTS (SELECT 1 FROM fx_fleet_classes c WHERE c.profile IS NOT DISTINCT FROM f.profile)
UNION ALL SELECT p.profile, NULL, r.name, 21, 'R21_required_class' FROM (SELECT profile FROM fx_fleet_classes UNION SELECT profile FROM fx_fleets) p,
  (VALUES ('default'), ('large')) r(name)
  WHERE NOT EXISTS (SELECT 1 FROM fx_fleet_classes c WHERE c.profile = p.profile AND c.name = r.name)
"""))(lambda spark, sf: rl.class_rule_violations(fixture(spark, sf, "fx_fleet_classes"), fixture(spark, sf, "fx_fleets")))


def _profile_rules_sql() -> str:
    isrepo, net, routing = "scope = 'repository'", "network_policy IS NOT NULL", "coalesce(routing_labels, '') <> ''"
    repos = "list_filter(coalesce(string_split(repositories, ','), []), lambda x: x <> '')"
    labels = "string_split(routing_labels, ',')"
    hook = "(listen_host IS NOT NULL OR listen_port IS NOT NULL OR secret_env IS NOT NULL)"
    closed = """
        CASE split_part(p, '.', 1)
          WHEN 'github' THEN CASE WHEN scope = 'repository'
            THEN p NOT IN ('github.scope', 'github.owner', 'github.runner_group_id', 'github.runner_group', 'github.repositories')
            ELSE p NOT IN ('github.scope', 'github.org', 'github.runner_group') END
          WHEN 'routing' THEN p <> 'routing.required_labels'
          WHEN 'network' THEN p NOT IN ('network.policy', 'network.cidr_allow_list', 'network.domain_allow_list')
          WHEN 'poller' THEN p NOT IN ('poller.interval_secs', 'poller.request_spacing_secs')
          WHEN 'webhook' THEN p NOT IN ('webhook.listen', 'webhook.hmac_env')
          WHEN 'watchdog' THEN p <> 'watchdog.github_queue_scan'
          WHEN 'lifecycle' THEN p NOT IN ('lifecycle.ephemeral', 'lifecycle.auto_stop_minutes', 'lifecycle.auto_delete_interval',
            'lifecycle.idle_refresh_secs', 'lifecycle.demand_idle_secs', 'lifecycle.job_max_secs', 'lifecycle.hold_on_failure_secs',
            'lifecycle.idle_poll_secs', 'lifecycle.fast_idle_poll_secs', 'lifecycle.fast_idle_window_secs', 'lifecycle.busy_poll_secs')
          ELSE false END"""
    name = _full('l', "^[a-z0-9][a-z0-9-]*$")
    rules = [
        (1, "R1_manifest_version", "manifest_version IS NULL OR manifest_version <> 1"),
        (5, "R5_unknown_key", f"list_bool_or(list_transform(string_split(config_paths, ','), lambda p: {closed}))"),
        (8, "R8_repositories_empty", f"{isrepo} AND len({repos}) = 0"),
        (8, "R8_repository_name", f"{isrepo} AND list_bool_or(list_transform({repos}, lambda r: NOT {_full('r', _REPOSITORY)}))"),
        (8, "R8_repository_duplicate", f"{isrepo} AND len(list_distinct(list_transform({repos}, lambda r: lower(r)))) <> len({repos})"),
        (12, "R12_routing_without_network", f"NOT ({net}) AND routing_labels IS NOT NULL"),
        (12, "R12_routing_missing", f"{net} AND NOT ({routing})"),
        (12, "R12_label_name", f"{net} AND {routing} AND list_bool_or(list_transform({labels}, lambda l: NOT {name}))"),
        (12, "R12_label_shared", f"{net} AND {routing} AND list_bool_or(list_transform({labels}, lambda l: l IN ('self-hosted', 'daytona', 'cipool', 'large')))"),
        (12, "R12_label_duplicate", f"{net} AND {routing} AND len(list_distinct({labels})) <> len({labels})"),
        (12, "R12_label_group", f"{isrepo} AND {net} AND {routing} AND (runner_group IS NULL OR list_distinct({labels}) <> [runner_group])"),
        (12, "R12_group_reserved", f"{isrepo} AND NOT ({net}) AND runner_group IS NOT NULL"),
        (15, "R15_listen_host", f"{hook} AND (listen_host IS NULL OR listen_host NOT IN ('127.0.0.1', '0.0.0.0', '::1', 'localhost'))"),
        (15, "R15_listen_port", f"{hook} AND (listen_port IS NULL OR listen_port < 1 OR listen_port > 65535)"),
        (15, "R15_secret_env", "NOT regexp_full_match(secret_env, '[A-Z][A-Z0-9_]{0,63}')"),
        (16, "R16_negative", "least(hold_on_failure_secs, idle_poll_secs, fast_idle_poll_secs, fast_idle_window_secs, busy_poll_secs, "
                             "job_max_secs, idle_refresh_secs, demand_idle_secs, auto_stop_minutes) < 0"),
        (16, "R16_poll", "idle_poll_secs < 1 OR busy_poll_secs < 1 OR fast_idle_poll_secs < 1"),
        (17, "R17_watchdog_bool", "watchdog_enabled NOT IN ('true', 'false')"),
        (22, "R22_forbidden_key", "list_bool_or(list_transform(string_split(config_paths, ','), lambda p: regexp_matches(p, '(?:api[_-]?key|token|secret|password|private)', 'i')))"),
        (23, "R23_installation_id", "installation_id IS NULL OR installation_id <> configured_installation_id"),
        (23, "R23_target_type", f"target_type <> CASE WHEN {isrepo} THEN 'User' ELSE 'Organization' END"),
        (23, "R23_login", "lower(login) <> lower(owner)"),
        (23, "R23_selection", "repository_selection <> 'all'"),
    ]
    return "\nUNION ALL ".join(
        f"SELECT fleet_pos, profile, {n} AS rule_no, '{rid}' AS rule_id FROM fx_profiles WHERE coalesce({cond}, false)"
        for n, rid, cond in rules)


register("profile_rule_violations", oracle_with(["fx_profiles"], _profile_rules_sql()))(
    lambda spark, sf: rl.profile_rule_violations(fixture(spark, sf, "fx_profiles")))
