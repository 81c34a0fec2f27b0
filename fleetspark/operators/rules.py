"""Configuration rule checks as one scan per table.

Each row rule is a boolean Spark expression; all of a table's rules are
evaluated in a single projection and exploded into (entity, rule_id,
detail) rows.  Uniqueness rules are grouped counts.  Every violation is
reported, in rule order (W9 picks the first per entity).  A missing value
that a rule needs is a violation: each condition says what null means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import (DOMAIN_NAME, ENV_NAME, FLEET_NAME, FORBIDDEN_CONFIG_KEYS, CLOSED_KEYS,  # noqa: F401
                     GITHUB_KEYS, LIFECYCLE_POLLS, LIFECYCLE_SECS, LISTEN_HOSTS,
                     NETWORK_POLICY, ORG_RUNNER_GROUP, OWNER_NAME, PRIVATE_V4,
                     PROVIDER_API_BASE, PROVIDER_TARGET, REPOSITORY_NAME, REQUIRED_CLASSES, RUNNER_GROUP_NAME,
                     PROJECT, PROVIDER_LABEL, Project, SCOPES)

# Octets have no leading zeros; after the slash stands a prefix length (any
# leading zeros skipped) or a dotted mask; without a slash it is one address.
_OCTET = r"(0|[1-9][0-9]{0,2})"
_ADDRESS = r"\.".join([_OCTET] * 4)
_CIDR = rf"^{_ADDRESS}(?:/0*([0-9]{{1,2}})|/{_ADDRESS})?$"


def _ip_int(text: str) -> int:
    a, b, c, d = (int(x) for x in text.split("."))
    return (a << 24) | (b << 16) | (c << 8) | d


def _full(c: Column, pattern: str) -> Column:
    """Python ``fullmatch``: Java's ``$`` also matches before a final newline."""
    return F.coalesce(c.rlike(pattern.removesuffix("$") + r"\z"), F.lit(False))


def cidr_checks(c: Column) -> Column:
    """struct(valid, private, normalised) for one IPv4 network text.

    Prefix lengths, netmasks, host masks and bare addresses are accepted;
    host bits are not.  ``normalised`` is ``first address/prefix length``
    with the address as an integer, null when invalid.
    """
    return cidr_list_checks(F.array(c))[0]


def cidr_list_checks(texts: Column) -> Column:
    """:func:`cidr_checks` for each text of an array, null for a null array.

    Every text is matched once: the matches, what follows from them and the
    verdict are three transforms one after another, so no step repeats the
    work of the one before.
    """
    full = F.lit((1 << 32) - 1)
    power = lambda x: x.bitwiseAND(x + 1) == 0  # noqa: E731  # all ones from the lowest bit
    length = lambda x: F.lit(32) - F.round(F.log2((x + 1).cast("double"))).cast("long")

    def address(p: Column, at: int) -> Column:
        return p[at] * (1 << 24) + p[at + 1] * (1 << 16) + p[at + 2] * (1 << 8) + p[at + 3]

    def matched(c: Column) -> Column:
        # the groups stand behind their place, so that missing ones stay told apart
        groups = F.regexp_replace(c, _CIDR.removesuffix("$") + r"\z", ",".join(f"${i}" for i in range(1, 10)))
        found = F.coalesce(c.rlike(_CIDR.removesuffix("$") + r"\z"), F.lit(False))
        return F.when(found, F.transform(F.split(groups, ","), lambda g: g.try_cast("long")))

    def parsed(p: Column) -> Column:
        mask = address(p, 5)
        masked = p[5].isNotNull()
        plen = (F.when(masked & power(full - mask), length(full - mask)).when(masked & power(mask), length(mask))
                .when(masked, F.lit(None).cast("long")).when(p[4].isNotNull(), p[4]).otherwise(F.lit(32).cast("long")))
        return F.when(p.isNotNull() & (F.array_max(F.concat(F.slice(p, 1, 4), F.slice(p, 6, 4))) <= 255),
                      F.struct(address(p, 0).alias("ip"), plen.alias("plen")))

    def judged(x: Column) -> Column:
        size = F.pow(F.lit(2.0), F.lit(32) - x["plen"]).cast("long")
        valid = F.coalesce((x["plen"] <= 32) & (x["ip"] % size == 0), F.lit(False))
        in_private = F.lit(False)
        for first, bits in PRIVATE_V4:
            lo, hi = _ip_int(first), _ip_int(first) + (1 << (32 - bits)) - 1
            in_private = in_private | ((x["ip"] >= lo) & (x["ip"] + size - 1 <= hi))
        return F.struct(valid.alias("valid"), F.coalesce(valid & in_private, F.lit(False)).alias("private"),
                        F.when(valid, F.concat_ws("/", x["ip"].cast("string"), x["plen"].cast("string"))).alias("normalised"))

    return F.transform(F.transform(F.transform(texts, matched), parsed), judged)


def _is(cond: Column) -> Column:
    """A condition with null as false, for use under ``~``."""
    return F.coalesce(cond, F.lit(False))


def _rows(df: DataFrame, entity: list[str], rules: list[tuple[int, str, Column]]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(n).alias("rule_no"), F.lit(rid).alias("rule_id"),
                             F.coalesce(cond, F.lit(False)).alias("failed")) for n, rid, cond in rules])
    return (df.select(*entity, F.explode(F.filter(arr, lambda x: x["failed"])).alias("v"))
            .select(*entity, "v.rule_no", "v.rule_id"))


def fleet_rule_violations(fleets: DataFrame) -> DataFrame:
    """Row and grouped rules over the fleet manifest / profile table:
    R2 name pattern and uniqueness, R3 owner pattern and (scope, owner)
    uniqueness, R4 scope, R6 organization runner group, R7 repository group
    id/name, R9 target pattern, R10 network policy and CIDRs, R11 domains,
    R13 cache volume, R14 poll interval and request spacing, R24 API base."""
    c = F.col
    is_repo = c("scope") == "repository"
    fleets = fleets.withColumn("_cidrs", cidr_list_checks(F.split("cidr_allow_list", ",")))
    cidrs = c("_cidrs")
    networks = F.filter(F.transform(cidrs, lambda x: x["normalised"]), lambda x: x.isNotNull())
    domains = F.split(c("domain_allow_list"), ",")
    has_net = c("network_policy").isNotNull()
    rules = [
        (2, "R2_fleet_name", ~_full(c("fleet"), FLEET_NAME)),
        (3, "R3_owner_name", ~_full(c("owner"), OWNER_NAME)),
        (4, "R4_scope", ~_is(c("scope").isin(*SCOPES))),
        (4, "R4_profile_scope", ~_is(F.coalesce(c("profile_scope"), F.lit("organization")) == c("scope"))),
        (6, "R6_owner", ~_is(c("profile_owner") == c("owner"))),
        (6, "R6_org_runner_group", (c("scope") == "organization") & ~F.coalesce(c("runner_group") == ORG_RUNNER_GROUP,
                                                                               F.lit(False))),
        (7, "R7_repo_group_exactly_one", is_repo & (c("runner_group").isNull() == c("runner_group_id").isNull())),
        (7, "R7_repo_group_id", is_repo & c("runner_group_id").isNotNull() & (c("runner_group_id") < 1)),
        (7, "R7_repo_group_name", is_repo & c("runner_group").isNotNull() & ~_full(c("runner_group"), RUNNER_GROUP_NAME)),
        (9, "R9_target", ~_full(c("target"), PROVIDER_TARGET)),
        (10, "R10_network_scope", has_net & ~is_repo),
        (10, "R10_network_policy", has_net & (c("network_policy") != NETWORK_POLICY)),
        (10, "R10_cidr_count", has_net & (~F.coalesce(F.size(cidrs).between(1, 5), F.lit(False)))),
        (10, "R10_cidr_invalid", has_net & F.exists(cidrs, lambda x: ~x["valid"])),
        (10, "R10_cidr_public", has_net & F.exists(cidrs, lambda x: x["valid"] & ~x["private"])),
        (10, "R10_cidr_duplicate", has_net & (F.size(F.array_distinct(networks)) != F.size(networks))),
        (11, "R11_domains_missing", has_net & (domains.isNull() | (c("domain_allow_list") == ""))),
        (11, "R11_domain_invalid", has_net & F.exists(domains, lambda d: ~_full(d, DOMAIN_NAME))),
        (11, "R11_domain_duplicate", has_net & (F.size(F.array_distinct(F.transform(domains, F.lower)))
                                                != F.size(domains))),
        (13, "R13_cache_volume", c("cache_volume").isNotNull() & (F.trim("cache_volume") == "")),
        (14, "R14_poll_interval", (c("poll_interval_secs") < 1) | (is_repo & (c("poll_interval_secs") < 60))),
        (14, "R14_request_spacing", c("request_spacing_secs") < 0),
        (9, "R9_profile_path", ~_is((c("profile") != "") & ~c("profile").startswith("/") & ~c("profile").contains(".."))),
        (9, "R9_installation_key", ~_is(c("installation_key").rlike(r"^[1-9][0-9]*$"))),
        (24, "R24_api_base", c("api_base") != PROVIDER_API_BASE),
    ]
    row = _rows(fleets, ["fleet_pos", "fleet"], rules)
    dup_name = (fleets.join(fleets.groupBy("fleet").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "fleet")
                .select("fleet_pos", "fleet", F.lit(2).alias("rule_no"), F.lit("R2_fleet_unique").alias("rule_id")))
    owner_key = [c("scope"), F.lower("owner").alias("_lo")]
    dup_owner = (fleets.select("fleet_pos", "fleet", *owner_key)
                 .join(fleets.groupBy(*owner_key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), ["scope", "_lo"])
                 .select("fleet_pos", "fleet", F.lit(3).alias("rule_no"), F.lit("R3_scope_owner_unique").alias("rule_id")))
    none = fleets.agg(F.count(F.lit(1)).alias("_n")).filter("_n = 0").select(
        F.lit(None).cast(fleets.schema["fleet_pos"].dataType).alias("fleet_pos"), F.lit(None).cast("string").alias("fleet"),
        F.lit(1).alias("rule_no"), F.lit("R1_no_fleet").alias("rule_id"))
    return row.unionByName(dup_name).unionByName(dup_owner).unionByName(none)


def class_rule_violations(classes: DataFrame, fleets: DataFrame, project: Project = PROJECT) -> DataFrame:
    """Size-class rules per profile: R18 labels include self-hosted and
    the provider label (or, with routing labels, all of these and neither
    the provider nor the project label), unique class name, at least one class for every
    profile of ``fleets`` or ``classes``; R19 snapshot text, min_idle/max >= 0, min <= max,
    repository scope min_idle = 0; R20 warm_floor_reason iff min_idle > 0;
    R21 required classes present in each of these profiles (large carrying label 'large')."""
    c = F.col
    scope = fleets.groupBy("profile").agg(F.min(F.struct("scope", "routing_labels")).alias("_p")).select(
        "profile", "_p.scope", "_p.routing_labels")
    j = (classes.join(scope, "profile", "left").withColumn("_labels", F.split("labels", ","))
         .withColumn("_routing", F.split("routing_labels", ",")))
    has = lambda label: _is(F.array_contains("_labels", label))
    routed = c("routing_labels").isNotNull()
    covered = _is(F.size(F.array_except("_routing", "_labels")) == 0)
    rules = [
        (18, "R18_labels", ~has("self-hosted") | (~routed & ~has(PROVIDER_LABEL))),
        (18, "R18_routing_shared", routed & (has(PROVIDER_LABEL) | has(project.label))),
        (18, "R18_routing_missing", routed & ~covered),
        (19, "R19_snapshot", ~_is(F.trim("snapshot") != "")),
        (19, "R19_min_idle", ~_is(c("min_idle") >= 0)),
        (19, "R19_max", ~_is(c("max_live") >= 0)),
        (19, "R19_min_le_max", c("min_idle") > c("max_live")),
        (19, "R19_repo_min_zero", (c("scope") == "repository") & ~_is(c("min_idle") == 0)),
        (20, "R20_warm_floor_reason", F.when(_is(c("min_idle") > 0), ~_is(F.trim("warm_floor_reason") != ""))
         .otherwise(c("warm_floor_reason").isNotNull())),
        (21, "R21_large_label", (c("name") == "large") & ~has("large")),
    ]
    row = _rows(j, ["profile", "class_pos", "name"], rules)
    dup = (classes.join(classes.groupBy("profile", "name").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"),
                        ["profile", "name"])
           .select("profile", "class_pos", "name", F.lit(18).alias("rule_no"), F.lit("R18_unique_name").alias("rule_id")))
    present = classes.filter(c("name").isin(*REQUIRED_CLASSES)).select("profile", "name").distinct()
    profiles = fleets.select("profile").unionByName(classes.select("profile")).distinct()
    empty = profiles.join(classes.select("profile").distinct(), "profile", "left_anti").select(
        "profile", F.lit(None).cast("long").alias("class_pos"), F.lit(None).cast("string").alias("name"),
        F.lit(18).alias("rule_no"), F.lit("R18_no_class").alias("rule_id"))
    need = profiles.withColumn("name", F.explode(F.array(*[F.lit(x) for x in REQUIRED_CLASSES])))
    missing = need.join(present, ["profile", "name"], "left_anti").select(
        "profile", F.lit(None).cast("long").alias("class_pos"), "name", F.lit(21).alias("rule_no"),
        F.lit("R21_required_class").alias("rule_id"))
    return row.unionByName(dup).unionByName(empty).unionByName(missing)


def profile_rule_violations(profiles: DataFrame, project: Project = PROJECT) -> DataFrame:
    """Profile rules: R1 manifest version, R5 closed key lists per table, R8
    repositories (non-empty, pattern, unique ignoring case; repository
    scope), R12 routing labels (only and always with a network policy,
    pattern, not shared, unique, together the runner group, which is
    reserved for them), R15 webhook listen host/port/secret env name where
    the profile has a webhook section (any of the three; the secret's name
    has a default), R16
    lifecycle values, R17 watchdog flag, R22 credential-like keys anywhere,
    R23 installation metadata (configured id, target type, login, selection
    'all')."""
    c = F.col
    is_repo = c("scope") == "repository"
    repos = F.filter(F.coalesce(F.split(c("repositories"), ","), F.array().cast("array<string>")), lambda x: x != "")
    has_net, has_routing = c("network_policy").isNotNull(), _is(c("routing_labels") != "")
    labels = F.split(c("routing_labels"), ",")
    paths = F.split(c("config_paths"), ",")
    target = F.when(is_repo, "User").otherwise("Organization")
    github = F.when(is_repo, F.array(*[F.lit(f"github.{k}") for k in GITHUB_KEYS["repository"]])).otherwise(
        F.array(*[F.lit(f"github.{k}") for k in GITHUB_KEYS["organization"]]))

    def unknown(path: Column) -> Column:
        out = path.startswith("github.") & ~F.array_contains(github, path)
        for table, names in CLOSED_KEYS.items():
            out = out | (path.startswith(f"{table}.") & ~path.isin(*[f"{table}.{k}" for k in names]))
        return out

    has_hook = F.coalesce("listen_host", c("listen_port").cast("string"), "secret_env").isNotNull()
    negative, slow = F.lit(False), F.lit(False)
    for key in LIFECYCLE_SECS:  # keys that are absent are null
        negative = negative | _is(c(key) < 0)
        if key in LIFECYCLE_POLLS:
            slow = slow | _is(c(key) < 1)
    rules = [
        (1, "R1_manifest_version", ~_is(c("manifest_version") == 1)),
        (5, "R5_unknown_key", F.exists(paths, unknown)),
        (8, "R8_repositories_empty", is_repo & (F.size(repos) == 0)),
        (8, "R8_repository_name", is_repo & F.exists(repos, lambda r: ~_full(r, REPOSITORY_NAME))),
        (8, "R8_repository_duplicate", is_repo & (F.size(F.array_distinct(F.transform(repos, F.lower))) != F.size(repos))),
        (12, "R12_routing_without_network", ~has_net & c("routing_labels").isNotNull()),
        (12, "R12_routing_missing", has_net & ~has_routing),
        (12, "R12_label_name", has_net & has_routing & F.exists(labels, lambda l: ~_full(l, RUNNER_GROUP_NAME))),
        (12, "R12_label_shared", has_net & has_routing & F.exists(labels, lambda l: l.isin(*project.shared_labels))),
        (12, "R12_label_duplicate", has_net & has_routing & (F.size(F.array_distinct(labels)) != F.size(labels))),
        (12, "R12_label_group", is_repo & has_net & has_routing & ~_is(F.array_distinct(labels) == F.array("runner_group"))),
        (12, "R12_group_reserved", is_repo & ~has_net & c("runner_group").isNotNull()),
        (15, "R15_listen_host", has_hook & ~_is(F.lower(F.trim("listen_host")).isin(*LISTEN_HOSTS))),
        (15, "R15_listen_port", has_hook & ~_is(c("listen_port").between(1, 65535))),
        (15, "R15_secret_env", c("secret_env").isNotNull() & ~_full(c("secret_env"), ENV_NAME)),
        (16, "R16_negative", negative),
        (16, "R16_poll", slow),
        (17, "R17_watchdog_bool", ~_is(F.coalesce(c("watchdog_enabled"), F.lit("true")).isin("true", "false"))),
        (22, "R22_forbidden_key", F.exists(paths, lambda p: p.rlike(FORBIDDEN_CONFIG_KEYS))),
        (23, "R23_installation_id", ~_is(c("installation_id") == c("configured_installation_id"))),
        (23, "R23_target_type", ~_is(c("target_type") == target)),
        (23, "R23_login", ~_is(F.lower("login") == F.lower("owner"))),
        (23, "R23_selection", ~_is(c("repository_selection") == "all")),
    ]
    return _rows(profiles, ["fleet_pos", "profile"], rules)
