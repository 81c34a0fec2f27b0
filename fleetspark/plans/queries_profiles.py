"""Registered queries over nested profile and manifest documents (2.8: R1 to R22 by presence and type)."""

from __future__ import annotations

from ..catalog import register
from ..operators import profiles as pf
from ..sources.fixtures import fixture, oracle_with
from .queries_config import _full, cidr_ctes

_KIND = """CASE json_type({v}) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean'
 WHEN 'NULL' THEN 'null' WHEN 'DOUBLE' THEN 'number' WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer' WHEN 'HUGEINT' THEN 'integer' END"""

# every node of every document, children by json_each
_NODES = f"""(WITH RECURSIVE w AS (
  SELECT profile_no, scope, '' AS path, NULL::VARCHAR AS parent, NULL::VARCHAR AS key, 0 AS depth, TRY_CAST(body AS JSON) AS v
  FROM fx_profile_documents WHERE json_type(TRY_CAST(body AS JSON)) = 'OBJECT'
  UNION ALL
  SELECT w.profile_no, w.scope,
    CASE WHEN json_type(w.v) = 'ARRAY' THEN w.path || '[' || e.key || ']' WHEN w.path = '' THEN e.key ELSE w.path || '.' || e.key END,
    w.path, CASE WHEN json_type(w.v) = 'OBJECT' THEN e.key END, w.depth + 1, e.value
  FROM w, json_each(w.v) e WHERE json_type(w.v) IN ('OBJECT', 'ARRAY'))
SELECT profile_no, scope, path, parent, key, depth, {_KIND.format(v='v')} AS type,
  CASE WHEN json_type(v) NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN json_extract_string(v, '$') END AS value FROM w WHERE depth > 0)"""

register("profile_nodes", oracle_with(["fx_profile_documents"], f"""
SELECT profile_no, path, parent, key, depth, type, value FROM {_NODES} n
"""))(lambda spark, sf: pf.walk(fixture(spark, sf, "fx_profile_documents"), ["profile_no"]))


def _kind(path: str) -> str:
    return _KIND.format(v=f"json_extract(doc, '$.{path}')")


def _is(path: str, kind: str) -> str:
    return f"(coalesce({_kind(path)}, '-') = '{kind}')"


def _there(path: str) -> str:
    return f"(coalesce({_kind(path)}, 'null') <> 'null')"


def _text(path: str) -> str:
    return f"(CASE WHEN {_is(path, 'string')} THEN json_extract_string(doc, '$.{path}') END)"


def _number(path: str) -> str:
    return f"(CASE WHEN {_is(path, 'integer')} THEN TRY_CAST(json_extract_string(doc, '$.{path}') AS HUGEINT) END)"


def _items(path: str) -> str:
    return (f"(CASE WHEN {_is(path, 'array')} THEN list_transform(TRY_CAST(json_extract(doc, '$.{path}') AS JSON[]), "
            "lambda e: CASE WHEN json_type(e) = 'VARCHAR' THEN json_extract_string(e, '$') END) END)")


def _profile_sql() -> str:
    repo = "scope = 'repository'"
    sections = {"github": 6, "daytona": 9, "network": 10, "routing": 12, "cache": 13, "poller": 14, "webhook": 15, "lifecycle": 16,
                "watchdog": 17}
    needed = {"daytona.target": "string", "network.policy": "string", "network.cidr_allow_list": "array",
              "network.domain_allow_list": "array", "routing.required_labels": "array", "cache.volume": "string",
              "poller.interval_secs": "integer", "webhook.listen": "string"}
    seconds = ["hold_on_failure_secs", "idle_poll_secs", "fast_idle_poll_secs", "fast_idle_window_secs", "busy_poll_secs",
               "job_max_secs", "idle_refresh_secs", "demand_idle_secs", "auto_stop_minutes"]
    typed = {**needed, "poller.request_spacing_secs": "integer", "webhook.hmac_env": "string",
             "watchdog.github_queue_scan": "boolean", **{f"lifecycle.{k}": "integer" for k in seconds}}
    rules = [(5, "R5_unreadable", "", "doc IS NULL"), (6, "R6_section_missing", "github", f"doc IS NOT NULL AND NOT {_there('github')}"),
             (9, "R9_section_missing", "daytona", f"doc IS NOT NULL AND NOT {_there('daytona')}")]
    rules += [(n, f"R{n}_section_type", s, f"{_there(s)} AND NOT {_is(s, 'object')}") for s, n in sections.items()]
    rules += [(sections[p.split('.')[0]], f"R{sections[p.split('.')[0]]}_key_missing", p,
               f"{_is(p.split('.')[0], 'object')} AND {_kind(p)} IS NULL") for p in needed]
    rules += [(sections[p.split('.')[0]], f"R{sections[p.split('.')[0]]}_key_type", p, f"{_kind(p)} <> '{t}'") for p, t in typed.items()]
    hub, group, ident = _is("github", "object"), "github.runner_group", "github.runner_group_id"
    repos, domains, labels = _items("github.repositories"), _items("network.domain_allow_list"), _items("routing.required_labels")
    name = "^[a-z0-9][a-z0-9-]*$"
    listen = _text("webhook.listen")
    host = f"lower(trim(regexp_replace({listen}, ':[^:]*$', '')))"
    port = f"TRY_CAST(trim(list_last(string_split({listen}, ':'))) AS BIGINT)"
    hooked = f"contains({listen}, ':')"
    nets = "list_transform(list_filter(cidrs, lambda c: c.valid), lambda c: c.net)"
    rules += [
        (6, "R6_owner", "github.org", f"{hub} AND scope = 'organization' AND {_text('github.org')} IS DISTINCT FROM owner"),
        (6, "R6_owner", "github.owner", f"{hub} AND {repo} AND {_text('github.owner')} IS DISTINCT FROM owner"),
        (4, "R4_scope", "github.scope", f"{hub} AND CASE WHEN {_kind('github.scope')} IS NULL THEN 'organization' ELSE {_text('github.scope')} END IS DISTINCT FROM scope"),
        (6, "R6_org_runner_group", group, f"{hub} AND scope = 'organization' AND {_text(group)} IS DISTINCT FROM 'daytona'"),
        (7, "R7_repo_group_exactly_one", "github", f"{hub} AND {repo} AND {_there(group)} = {_there(ident)}"),
        (7, "R7_repo_group_id", ident, f"{hub} AND {repo} AND {_there(ident)} AND coalesce({_number(ident)}, 0) < 1"),
        (7, "R7_repo_group_name", group, f"{hub} AND {repo} AND {_there(group)} AND NOT {_full(_text(group), name)}"),
        (8, "R8_repositories_empty", "github.repositories", f"{hub} AND {repo} AND coalesce(len({repos}), 0) = 0"),
        (8, "R8_repository_name", "github.repositories", f"{hub} AND {repo} AND list_bool_or(list_transform({repos}, lambda r: NOT {_full('r', '[.]github|[A-Za-z0-9][A-Za-z0-9._-]*')}))"),
        (8, "R8_repository_duplicate", "github.repositories", f"{hub} AND {repo} AND len(list_distinct(list_transform({repos}, lambda r: coalesce(lower(r), '?')))) <> len({repos})"),
        (9, "R9_target", "daytona.target", f"{_is('daytona.target', 'string')} AND NOT {_full(_text('daytona.target'), '[a-z0-9][a-z0-9-]{0,62}')}"),
        (10, "R10_network_scope", "network", f"{_there('network')} AND NOT {repo}"),
        (10, "R10_network_policy", "network.policy", f"{_text('network.policy')} <> 'deny-by-default'"),
        (10, "R10_cidr_count", "network.cidr_allow_list", "cidr_count NOT BETWEEN 1 AND 5"),
        (10, "R10_cidr_invalid", "network.cidr_allow_list", "cidr_count > 0 AND list_bool_or(list_transform(cidrs, lambda c: NOT c.valid))"),
        (10, "R10_cidr_public", "network.cidr_allow_list", "cidr_count > 0 AND list_bool_or(list_transform(cidrs, lambda c: c.valid AND NOT c.private))"),
        (10, "R10_cidr_duplicate", "network.cidr_allow_list", f"cidr_count > 0 AND len(list_distinct({nets})) <> len({nets})"),
        (11, "R11_domains_missing", "network.domain_allow_list", f"len({domains}) = 0"),
        (11, "R11_domain_invalid", "network.domain_allow_list", f"list_bool_or(list_transform({domains}, lambda d: NOT {_full('d', '([*][.])?([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?[.])+[a-z]{2,63}')}))"),
        (11, "R11_domain_duplicate", "network.domain_allow_list", f"len(list_distinct(list_transform({domains}, lambda d: coalesce(lower(d), '?')))) <> len({domains})"),
        (12, "R12_routing_without_network", "routing", f"{_there('routing')} AND NOT {_there('network')}"),
        (12, "R12_routing_missing", "routing", f"{_is('network', 'object')} AND NOT {_there('routing')}"),
        (12, "R12_labels_empty", "routing.required_labels", f"len({labels}) = 0"),
        (12, "R12_label_name", "routing.required_labels", f"list_bool_or(list_transform({labels}, lambda l: NOT {_full('l', name)}))"),
        (12, "R12_label_shared", "routing.required_labels", f"list_bool_or(list_transform({labels}, lambda l: l IN ('self-hosted', 'daytona', 'cipool', 'large')))"),
        (12, "R12_label_duplicate", "routing.required_labels", f"len(list_distinct({labels})) <> len({labels})"),
        (12, "R12_label_group", group, f"{hub} AND {repo} AND {_is('network', 'object')} AND len({labels}) > 0 AND list_distinct({labels}) IS DISTINCT FROM [{_text(group)}]"),
        (12, "R12_group_reserved", group, f"{hub} AND {repo} AND NOT {_there('network')} AND {_there(group)}"),
        (13, "R13_cache_volume", "cache.volume", f"trim({_text('cache.volume')}) = ''"),
        (14, "R14_poll_interval", "poller.interval_secs", f"{_number('poller.interval_secs')} < CASE WHEN {repo} THEN 60 ELSE 1 END"),
        (14, "R14_request_spacing", "poller.request_spacing_secs", f"{_number('poller.request_spacing_secs')} < 0"),
        (15, "R15_listen", "webhook.listen", f"NOT {hooked}"),
        (15, "R15_listen_host", "webhook.listen", f"{hooked} AND {host} NOT IN ('127.0.0.1', '0.0.0.0', '::1', 'localhost')"),
        (15, "R15_listen_port", "webhook.listen", f"{hooked} AND NOT coalesce({port} BETWEEN 1 AND 65535, false)"),
        (15, "R15_secret_env", "webhook.hmac_env", f"{_is('webhook.hmac_env', 'string')} AND NOT {_full(_text('webhook.hmac_env'), '[A-Z][A-Z0-9_]{0,63}')}"),
        (18, "R18_no_class", "size_class", f"doc IS NOT NULL AND coalesce(len({_items('size_class')}), 0) = 0"),
    ]
    rules += [(16, "R16_negative", f"lifecycle.{k}", f"{_number(f'lifecycle.{k}')} < 0") for k in seconds]
    rules += [(16, "R16_poll", f"lifecycle.{k}", f"{_number(f'lifecycle.{k}')} < 1") for k in ("idle_poll_secs", "fast_idle_poll_secs", "busy_poll_secs")]
    listed = ", ".join(f"{{'path': '{p}', 'rule_no': {n}, 'rule_id': '{r}', 'failed': coalesce({c}, false)}}" for n, r, p, c in rules)
    cidr = "network.cidr_allow_list"
    return f"""
, d0 AS (SELECT profile_no, scope, owner, CASE WHEN json_type(TRY_CAST(body AS JSON)) = 'OBJECT' THEN TRY_CAST(body AS JSON) END AS doc
         FROM fx_profile_documents),
d1 AS (SELECT *, len({_items(cidr)}) AS cidr_count,
       array_to_string(list_transform({_items(cidr)}, lambda x: coalesce(x, '?')), ',') AS cidr_allow_list FROM d0)
{cidr_ctes('d1')}
, found AS (SELECT profile_no, unnest([{listed}]) AS v FROM fc)
SELECT profile_no, v.path AS path, v.rule_no AS rule_no, v.rule_id AS rule_id FROM found WHERE v.failed
UNION ALL
SELECT profile_no, path, 22, 'R22_forbidden_key' FROM {_NODES} n WHERE regexp_matches(key, '(api[_-]?key|token|secret|password|private)', 'i')
UNION ALL
SELECT profile_no, path, 5, 'R5_unknown_key' FROM {_NODES} n WHERE depth = 2 AND CASE parent
  WHEN 'github' THEN CASE WHEN scope = 'repository' THEN key NOT IN ('scope', 'owner', 'runner_group_id', 'runner_group', 'repositories')
    ELSE key NOT IN ('scope', 'org', 'runner_group') END
  WHEN 'network' THEN key NOT IN ('policy', 'cidr_allow_list', 'domain_allow_list')
  WHEN 'routing' THEN key <> 'required_labels'
  WHEN 'poller' THEN key NOT IN ('interval_secs', 'request_spacing_secs')
  WHEN 'webhook' THEN key NOT IN ('listen', 'hmac_env')
  WHEN 'watchdog' THEN key <> 'github_queue_scan'
  WHEN 'lifecycle' THEN key NOT IN ('ephemeral', 'auto_delete_interval', {", ".join(f"'{k}'" for k in seconds)})
  ELSE false END
"""


register("profile_document_violations", oracle_with(["fx_profile_documents"], _profile_sql()))(
    lambda spark, sf: pf.profile_document_violations(fixture(spark, sf, "fx_profile_documents"), ["profile_no"]))


def _class_sql() -> str:
    keys = {"name": ("string", 18), "labels": ("array", 18), "snapshot": ("string", 19), "min_idle": ("integer", 19), "max": ("integer", 19)}
    parts = ["SELECT profile_no, 'size_class[' || pos || ']' AS path, 18 AS rule_no, 'R18_class_type' AS rule_id FROM item "
             "WHERE json_type(doc) <> 'OBJECT'"]
    for key, (kind, n) in keys.items():
        parts.append(f"""SELECT profile_no, 'size_class[' || pos || '].{key}', {n},
 CASE WHEN {_kind(key)} IS NULL THEN 'R{n}_key_missing' ELSE 'R{n}_key_type' END FROM item
 WHERE json_type(doc) = 'OBJECT' AND {_kind(key)} IS DISTINCT FROM '{kind}'""")
    parts.append(f"""SELECT profile_no, 'size_class[' || pos || '].labels', 18, 'R18_label_type' FROM item
 WHERE json_type(doc) = 'OBJECT' AND list_bool_or(list_transform({_items('labels')}, lambda l: coalesce(l, '') = ''))""")
    return """
, c AS (SELECT profile_no, TRY_CAST(json_extract(TRY_CAST(body AS JSON), '$.size_class') AS JSON[]) AS l FROM fx_profile_documents
        WHERE json_type(TRY_CAST(body AS JSON), '$.size_class') = 'ARRAY'),
item AS (SELECT profile_no, unnest(l) AS doc, CAST(unnest(range(len(l))) AS VARCHAR) AS pos FROM c)
""" + "\nUNION ALL ".join(parts)


register("class_document_violations", oracle_with(["fx_profile_documents"], _class_sql()))(
    lambda spark, sf: pf.class_document_violations(fixture(spark, sf, "fx_profile_documents"), ["profile_no"]))

_SCOPE = f"CASE WHEN {_kind('scope')} IS NULL THEN 'organization' ELSE {_text('scope')} END"
_OWNER = f"CASE WHEN {_SCOPE} = 'organization' THEN {_text('organization')} ELSE {_text('owner')} END"

register("manifest_violations", oracle_with(["fx_manifests"], f"""
, m AS (SELECT manifest_no, CASE WHEN json_type(TRY_CAST(body AS JSON)) = 'OBJECT' THEN TRY_CAST(body AS JSON) END AS doc FROM fx_manifests),
f AS (SELECT manifest_no, TRY_CAST(json_extract(doc, '$.fleet') AS JSON[]) AS l FROM m WHERE json_type(doc, '$.fleet') = 'ARRAY'),
u AS (SELECT manifest_no, unnest(l) AS doc, unnest(range(len(l))) AS pos FROM f),
e AS (SELECT manifest_no, pos, 'fleet[' || CAST(pos AS VARCHAR) || ']' AS base, doc, json_type(doc) = 'OBJECT' AS tab, {_SCOPE} AS scope,
        {_OWNER} AS owner, {_text('name')} AS name, {_text('profile')} AS profile, {_text('installation_id_key')} AS inst FROM u)
SELECT manifest_no, '' AS path, 5 AS rule_no, 'R5_unreadable' AS rule_id FROM m WHERE doc IS NULL
UNION ALL SELECT manifest_no, 'manifest.version', 1, 'R1_manifest_version' FROM m
  WHERE doc IS NOT NULL AND coalesce({_number('manifest.version')}, 0) <> 1
UNION ALL SELECT manifest_no, 'fleet', 1, 'R1_no_fleet' FROM m WHERE doc IS NOT NULL AND NOT EXISTS (SELECT 1 FROM u WHERE u.manifest_no = m.manifest_no)
UNION ALL SELECT manifest_no, base, 1, 'R1_entry_type' FROM e WHERE NOT tab
UNION ALL SELECT manifest_no, base || '.scope', 4, 'R4_scope' FROM e WHERE tab AND (scope IS NULL OR scope NOT IN ('organization', 'repository'))
UNION ALL SELECT manifest_no, base || '.name', 2, 'R2_fleet_name' FROM e WHERE tab AND NOT {_full('name', '[a-z0-9][a-z0-9-]*')}
UNION ALL SELECT manifest_no, base || '.owner', 3, 'R3_owner_name' FROM e
  WHERE tab AND scope IN ('organization', 'repository') AND NOT {_full('owner', '[A-Za-z0-9][A-Za-z0-9-]*')}
UNION ALL SELECT manifest_no, base || '.profile', 9, 'R9_profile_path' FROM e
  WHERE tab AND NOT coalesce(profile = 'config/fleets/' || name || '/runners.toml', false)
UNION ALL SELECT manifest_no, base || '.installation_id_key', 9, 'R9_installation_key' FROM e WHERE tab AND NOT {_full('inst', '[1-9][0-9]*')}
UNION ALL SELECT manifest_no, base || '.' || k, 5, 'R5_unknown_key' FROM (SELECT manifest_no, base, scope, unnest(json_keys(doc)) AS k FROM e WHERE tab) x
  WHERE (scope = 'organization' AND k NOT IN ('name', 'scope', 'profile', 'installation_id_key', 'organization'))
     OR (scope = 'repository' AND k NOT IN ('name', 'scope', 'profile', 'installation_id_key', 'owner'))
UNION ALL SELECT a.manifest_no, a.base || '.name', 2, 'R2_fleet_unique' FROM e a
  WHERE a.tab AND EXISTS (SELECT 1 FROM e b WHERE b.tab AND b.manifest_no = a.manifest_no AND b.pos < a.pos AND b.name IS NOT DISTINCT FROM a.name)
UNION ALL SELECT a.manifest_no, a.base || '.owner', 3, 'R3_scope_owner_unique' FROM e a
  WHERE a.tab AND EXISTS (SELECT 1 FROM e b WHERE b.tab AND b.manifest_no = a.manifest_no AND b.pos < a.pos
    AND b.scope IS NOT DISTINCT FROM a.scope AND lower(b.owner) IS NOT DISTINCT FROM lower(a.owner))
"""))(lambda spark, sf: pf.manifest_violations(fixture(spark, sf, "fx_manifests"), ["manifest_no"]))
