"""Nested profile documents: a walk over all nodes and the rules that need presence and type.

The flat tables of :mod:`.rules` cannot tell an absent section from an
absent key, nor a wrong type from a missing value.  Here a profile is its
document as JSON text, read as VARIANT: an absent section, an absent key and
a value of a wrong type are three different findings.

Defined cases: a null text, a text that is no JSON, one with a repeated key
and one whose root is no object give the single finding R5_unreadable and no
nodes; a section that is JSON null counts as absent, a key that is null as a
wrong type; whole decimals (``1.0``) count as integers, booleans do not;
repeated documents are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import (CLOSED_KEYS, DOMAIN_NAME, ENV_NAME, FLEET_NAME, FORBIDDEN_CONFIG_KEYS, GITHUB_KEYS, LIFECYCLE_POLLS,
                     LIFECYCLE_SECS, LISTEN_HOSTS, MANIFEST_KEYS, NETWORK_POLICY, ORG_RUNNER_GROUP, OWNER_KEYS, OWNER_NAME,
                     PROJECT, PROVIDER_TARGET, REPOSITORY_NAME, RUNNER_GROUP_NAME, SCOPES, Project)
from ..session import stored
from .rules import _full, _is, cidr_list_checks

#: Levels that one stage of the walk opens; deeper documents take another stage.  The code generated for more
#: levels is too long to be compiled well.
LEVELS = 4

#: Sections of a profile and the rule that each belongs to.
SECTIONS = {"github": 6, "daytona": 9, "network": 10, "routing": 12, "cache": 13, "poller": 14, "webhook": 15, "lifecycle": 16,
            "watchdog": 17}
REQUIRED_SECTIONS = ("github", "daytona")
#: (section, key, type, must be there)
KEYS = (("daytona", "target", "string", True), ("network", "policy", "string", True), ("network", "cidr_allow_list", "array", True),
        ("network", "domain_allow_list", "array", True), ("routing", "required_labels", "array", True),
        ("cache", "volume", "string", True), ("poller", "interval_secs", "integer", True),
        ("poller", "request_spacing_secs", "integer", False), ("webhook", "listen", "string", True),
        ("webhook", "hmac_env", "string", False), ("watchdog", "github_queue_scan", "boolean", False),
        *(("lifecycle", key, "integer", False) for key in LIFECYCLE_SECS))
#: Keys of a size class, their types and rules.
CLASS_KEYS = (("name", "string", 18), ("labels", "array", 18), ("snapshot", "string", 19), ("min_idle", "integer", 19),
              ("max", "integer", 19))


_KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "BIGINT": "integer",
          "DECIMAL(,)": "integer", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number"}


def kind(v: Column) -> Column:
    """object, array, string, integer, number, boolean or null; null where nothing stands."""
    # one look at the schema: its first word, with the brackets of a decimal that has no fraction
    head = F.regexp_replace(F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+(\([0-9]+,0\))?", 0), "[0-9]+", "")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair]), head)


def read_documents(documents: DataFrame, body: str = "body") -> DataFrame:
    """The text column replaced by ``doc``, a VARIANT object or null; parsed once for all that follows."""
    v = F.try_parse_json(F.col(body))
    return (documents.withColumn("_doc", F.explode(F.array(v))).drop(body)
            .withColumn("doc", F.when(kind(F.col("_doc")) == "object", F.col("_doc"))).drop("_doc"))


def nesting(text: Column) -> Column:
    """How deep brackets nest outside strings; for valid JSON the number of levels below the root."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\\.", ""), '"[^"]*"', "")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    at = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(acc: Column, mark: Column) -> Column:
        now = acc["now"] + F.when(mark.isin("{", "["), 1).when(mark.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["top"], now).alias("top"))

    return F.aggregate(marks, at, step)["top"]


def dealt(documents: DataFrame, columns: list[str], body: str = "body") -> DataFrame:
    """``columns, body, levels`` in a staged copy, dealt over all tasks; ``levels`` is null where the text is no JSON.

    A table of short rows is one or a few tasks, and each row costs much
    more than its bytes: the texts are made, parsed and walked by all tasks.
    """
    spark = documents.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(*dict.fromkeys([*columns, body])).repartition(tasks)
    return stored(spark, rows.withColumn("levels", F.when(F.try_parse_json(body).isNotNull(), nesting(F.col(body)))), "profiles")


def _open(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Each node with a rest becomes itself, closed, and its children."""
    c = F.col
    opens = F.when(c("rest").isNull(), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    twice = nodes.select("*", F.explode(opens).alias("opens")).withColumn("rest", F.when(c("opens"), c("rest")))
    items = twice.sparkSession.tvf.variant_explode_outer(c("rest").outer()).select(
        c("pos").alias("c_pos"), c("key").alias("c_key"), c("value").alias("v"))
    met = twice.lateralJoin(items).where(~c("opens") | c("c_pos").isNotNull())
    own = F.when(c("c_key").isNull(), F.concat(c("path"), F.lit("["), c("c_pos").cast("string"), F.lit("]"))).otherwise(
        F.concat_ws(".", F.when(c("path") != "", c("path")), c("c_key")))
    t, v = F.when(c("opens"), c("c_type")).otherwise(c("type")), c("v")
    return met.withColumn("c_type", kind(v)).select(
        *keys, F.when(c("opens"), own).otherwise(c("path")).alias("path"),
        F.when(c("opens"), c("path")).otherwise(c("parent")).alias("parent"),
        F.when(c("opens"), c("c_key")).otherwise(c("key")).alias("key"),
        F.when(c("opens"), c("depth") + 1).otherwise(c("depth")).alias("depth"), t.alias("type"),
        F.when(~c("opens"), c("value")).when(~c("c_type").isin("object", "array", "null"), F.try_variant_get(v, "$", "string")).alias("value"),
        F.when(c("c_type").isin("object", "array"), v).alias("rest"))


def walk(documents: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Every node below the root of each document: ``keys, path, parent, key, depth, type, value``.

    ``value`` is the text of a string, number or boolean.  List items have no
    ``key``; their path ends in ``[number]``.  The texts are dealt over all
    tasks once; levels are opened one after another by a generator, without
    a shuffle.  After every ``LEVELS`` of them the closed nodes are done and
    the open ones, of deeper documents alone, are checkpointed, so that
    neither the plan nor the work per node grows with the depth.
    """
    return _walk(dealt(documents, keys, body), keys, body)


def _walk(documents: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """:func:`walk` over documents that :func:`dealt` has staged."""
    deepest = documents.agg(F.max("levels")).first()[0] or 0
    kept = [*keys, "levels"]
    none = F.lit(None).cast("string")
    left = read_documents(documents, body).where("doc IS NOT NULL").select(
        *kept, F.lit("").alias("path"), none.alias("parent"), none.alias("key"), F.lit(0).alias("depth"),
        F.lit("object").alias("type"), none.alias("value"), F.col("doc").alias("rest"))
    done = None
    for first in range(0, max(deepest, 1), LEVELS):
        last = min(first + LEVELS, deepest)
        if first:
            left = _open_levels(left.where(F.col("levels") > first), kept, LEVELS).where("rest IS NOT NULL").checkpoint()
        closed = _open_levels(left, kept, last - first).where("rest IS NULL AND depth > 0").select(
            *keys, "path", "parent", "key", "depth", "type", "value")
        done = closed if done is None else done.unionByName(closed)
    return done


def _open_levels(nodes: DataFrame, keys: list[str], levels: int) -> DataFrame:
    for _ in range(levels):
        nodes = _open(nodes, keys)
    return nodes


def _findings(rows: DataFrame, keys: list[str], rules: list[tuple[int, str, str, Column]]) -> DataFrame:
    found = F.array(*[F.when(_is(cond), F.struct(F.lit(path).alias("path"), F.lit(n).alias("rule_no"), F.lit(rule).alias("rule_id")))
                      for n, rule, path, cond in rules])
    return rows.select(*keys, F.explode(F.array_compact(found)).alias("v")).select(*keys, "v.path", "v.rule_no", "v.rule_id")


def profile_document_violations(documents: DataFrame, keys: list[str], project: Project = PROJECT) -> DataFrame:
    """``keys, path, rule_no, rule_id`` for ``keys, scope, owner, body`` (scope and owner by the manifest).

    Sections: required ones present (R6, R9), any that is there an object,
    their required keys present and every key of its type (R6 to R17); closed
    key lists (R5) and credential-like keys at any depth (R22); then values:
    scope, owner, group and repositories (R4, R6 to R8), target (R9), network
    and routing (R10 to R12), cache (R13), poller (R14), webhook (R15),
    lifecycle (R16).  A rule on a value speaks only where the value has its
    type; an absent optional section has no finding.
    """
    documents = dealt(documents, [*keys, "scope", "owner"])
    nodes = _walk(documents, [*keys, "scope"])
    parsed = read_documents(documents)
    doc = F.col("doc")
    get = lambda path: F.try_variant_get(doc, f"$.{path}", "variant")
    paths = sorted({*SECTIONS, "size_class", *(f"{s}.{k}" for s, k, _, _ in KEYS),
                    *(f"github.{k}" for names in GITHUB_KEYS.values() for k in names)})
    lists = {"github.repositories", "size_class", *(f"{s}.{k}" for s, k, t, _ in KEYS if t == "array")}

    def read(p: str) -> Column:
        if p in lists:  # the items that are texts, null for the others
            held = F.transform(F.try_variant_get(doc, f"$.{p}", "array<variant>"), lambda v: F.when(
                kind(v) == "string", F.try_variant_get(v, "$", "string"))).alias("items")
        else:
            held = F.try_variant_get(doc, f"$.{p}", "string").alias("text")
        return F.struct(kind(get(p)).alias("type"), held).alias(p.replace(".", "__"))

    held = F.struct(*map(read, paths))  # types and values are made once, behind a generator
    rows = parsed.select(*keys, "scope", "owner", doc.isNull().alias("unreadable"), F.explode(F.array(held)).alias("h"))
    cell = lambda path: F.col("h")[path.replace(".", "__")]
    type_of = lambda path: cell(path)["type"]
    is_a = lambda path, t: _is(type_of(path) == t)
    text = lambda path: F.when(is_a(path, "string"), cell(path)["text"])
    number = lambda path: F.when(is_a(path, "integer"), cell(path)["text"].try_cast("decimal(38,0)"))
    there = lambda path: _is(type_of(path) != "null")
    is_repo, is_org = F.col("scope") == "repository", F.col("scope") == "organization"
    readable = ~F.col("unreadable")

    rules: list[tuple[int, str, str, Column]] = [(5, "R5_unreadable", "", F.col("unreadable"))]
    for section, n in SECTIONS.items():
        if section in REQUIRED_SECTIONS:
            rules.append((n, f"R{n}_section_missing", section, readable & ~there(section)))
        rules.append((n, f"R{n}_section_type", section, there(section) & ~is_a(section, "object")))
    for section, key, t, needed in KEYS:
        n, path = SECTIONS[section], f"{section}.{key}"
        if needed:
            rules.append((n, f"R{n}_key_missing", path, is_a(section, "object") & type_of(path).isNull()))
        rules.append((n, f"R{n}_key_type", path, type_of(path) != t))

    hub = is_a("github", "object")
    group, group_id = "github.runner_group", "github.runner_group_id"
    repos = cell("github.repositories")["items"]
    for scope, key in OWNER_KEYS["profile"].items():
        mine = hub & (F.col("scope") == scope)
        rules.append((6, "R6_owner", f"github.{key}", mine & ~_is((F.trim(text(f"github.{key}")) != "")
                                                               & (text(f"github.{key}") == F.col("owner")))))
    rules += [
        (4, "R4_scope", "github.scope", hub & ~_is(F.when(type_of("github.scope").isNull(), "organization")
                                                   .otherwise(text("github.scope")) == F.col("scope"))),
        (6, "R6_org_runner_group", group, hub & is_org & ~_is(text(group) == ORG_RUNNER_GROUP)),
        (7, "R7_repo_group_exactly_one", "github", hub & is_repo & (there(group) == there(group_id))),
        (7, "R7_repo_group_id", group_id, hub & is_repo & there(group_id) & ~_is(number(group_id) >= 1)),
        (7, "R7_repo_group_name", group, hub & is_repo & there(group) & ~_full(text(group), RUNNER_GROUP_NAME)),
        (8, "R8_repositories_empty", "github.repositories", hub & is_repo & ~_is(F.size(repos) > 0)),
        (8, "R8_repository_name", "github.repositories", hub & is_repo & F.exists(repos, lambda r: ~_full(r, REPOSITORY_NAME))),
        (8, "R8_repository_duplicate", "github.repositories", hub & is_repo & (
            F.size(F.array_distinct(F.transform(repos, F.lower))) != F.size(repos))),
        (9, "R9_target", "daytona.target", is_a("daytona.target", "string") & ~_full(text("daytona.target"), PROVIDER_TARGET)),
    ]

    net, path = is_a("network", "object"), "network.cidr_allow_list"
    cidrs = F.col("cidrs")
    networks = F.filter(F.transform(cidrs, lambda x: x["normalised"]), lambda x: x.isNotNull())
    domains, labels = cell("network.domain_allow_list")["items"], cell("routing.required_labels")["items"]
    rows = rows.withColumn("cidrs", F.explode(F.array(cidr_list_checks(cell(path)["items"]))))
    rules += [
        (10, "R10_network_scope", "network", there("network") & ~_is(is_repo)),
        (10, "R10_network_policy", "network.policy", is_a("network.policy", "string") & (text("network.policy") != NETWORK_POLICY)),
        (10, "R10_cidr_count", path, ~F.size(cidrs).between(1, 5)),
        (10, "R10_cidr_invalid", path, F.exists(cidrs, lambda x: ~x["valid"])),
        (10, "R10_cidr_public", path, F.exists(cidrs, lambda x: x["valid"] & ~x["private"])),
        (10, "R10_cidr_duplicate", path, F.size(F.array_distinct(networks)) != F.size(networks)),
        (11, "R11_domains_missing", "network.domain_allow_list", F.size(domains) == 0),
        (11, "R11_domain_invalid", "network.domain_allow_list", F.exists(domains, lambda d: ~_full(d, DOMAIN_NAME))),
        (11, "R11_domain_duplicate", "network.domain_allow_list",
         F.size(F.array_distinct(F.transform(domains, F.lower))) != F.size(domains)),
        (12, "R12_routing_without_network", "routing", readable & there("routing") & ~there("network")),
        (12, "R12_routing_missing", "routing", net & ~there("routing")),
    ]
    path = "routing.required_labels"
    rules += [
        (12, "R12_labels_empty", path, F.size(labels) == 0),
        (12, "R12_label_name", path, F.exists(labels, lambda x: ~_full(x, RUNNER_GROUP_NAME))),
        (12, "R12_label_shared", path, F.exists(labels, lambda x: x.isin(*project.shared_labels))),
        (12, "R12_label_duplicate", path, F.size(F.array_distinct(labels)) != F.size(labels)),
        (12, "R12_label_group", group, hub & is_repo & net & (F.size(labels) > 0)
         & ~_is(F.array_distinct(labels) == F.array(text(group)))),
        (12, "R12_group_reserved", group, hub & is_repo & ~there("network") & there(group)),
        (13, "R13_cache_volume", "cache.volume", F.trim(text("cache.volume")) == ""),
        (14, "R14_poll_interval", "poller.interval_secs", number("poller.interval_secs") < F.when(is_repo, 60).otherwise(1)),
        (14, "R14_request_spacing", "poller.request_spacing_secs", number("poller.request_spacing_secs") < 0),
    ]
    listen, hooked = text("webhook.listen"), text("webhook.listen").contains(":")
    host = F.lower(F.trim(F.regexp_replace(listen, r":[^:]*\z", "")))
    port = F.regexp_extract(listen, r":\s*([+-]?[0-9]+)\s*\z", 1).try_cast("decimal(38,0)")
    rules += [
        (15, "R15_listen", "webhook.listen", ~hooked),
        (15, "R15_listen_host", "webhook.listen", hooked & ~host.isin(*LISTEN_HOSTS)),
        (15, "R15_listen_port", "webhook.listen", hooked & ~_is(port.between(1, 65535))),
        (15, "R15_secret_env", "webhook.hmac_env", is_a("webhook.hmac_env", "string") & ~_full(text("webhook.hmac_env"), ENV_NAME)),
        (18, "R18_no_class", "size_class", readable & ~_is(F.size(cell("size_class")["items"]) > 0)),
    ]
    for key in LIFECYCLE_SECS:
        rules.append((16, "R16_negative", f"lifecycle.{key}", number(f"lifecycle.{key}") < 0))
        if key in LIFECYCLE_POLLS:
            rules.append((16, "R16_poll", f"lifecycle.{key}", number(f"lifecycle.{key}") < 1))

    # keys come from the walk: closed lists at the second level, credential-like names at every level
    github = F.create_map(*[x for scope, names in GITHUB_KEYS.items() for x in (F.lit(scope), F.array(*map(F.lit, names)))])
    unknown = (F.col("parent") == "github") & ~F.array_contains(github[F.col("scope")], F.col("key"))
    for section, names in CLOSED_KEYS.items():
        unknown = unknown | ((F.col("parent") == section) & ~F.col("key").isin(*names))
    by_key = F.array_compact(F.array(
        F.when((F.col("depth") == 2) & unknown, F.struct(F.lit(5).alias("rule_no"), F.lit("R5_unknown_key").alias("rule_id"))),
        F.when(F.col("key").rlike(FORBIDDEN_CONFIG_KEYS),
               F.struct(F.lit(22).alias("rule_no"), F.lit("R22_forbidden_key").alias("rule_id")))))
    of_keys = (nodes.select(*keys, "path", F.explode(by_key).alias("v")).select(*keys, "path", "v.rule_no", "v.rule_id"))
    return _findings(rows, keys, rules).unionByName(of_keys)


def size_classes(documents: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, class_pos, item``: the items of every document's ``size_class`` list, numbered from 0."""
    items = F.try_variant_get("doc", "$.size_class", "array<variant>")
    return read_documents(documents).select(*keys, F.posexplode(items).alias("class_pos", "item"))


def class_document_violations(documents: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, path, rule_no, rule_id``: R18 and R19 presence and type per size class of a document.

    An item that is no table, a key that is absent, a value of another type
    and a label that is no text or empty are told apart; what the values must
    be is :func:`.rules.class_rule_violations` over :func:`class_table`.
    """
    at = lambda key: F.try_variant_get("item", f"$.{key}", "variant")
    base = F.concat(F.lit("size_class["), F.col("class_pos").cast("string"), F.lit("]"))
    table = kind(F.col("item")) == "object"
    found = [F.when(~table, F.struct(base.alias("path"), F.lit(18).alias("rule_no"), F.lit("R18_class_type").alias("rule_id")))]
    for key, t, n in CLASS_KEYS:
        is_t = kind(at(key))
        rule = F.when(is_t.isNull(), f"R{n}_key_missing").when(is_t != t, f"R{n}_key_type")
        if key == "labels":
            odd = F.exists(F.try_variant_get(at(key), "$", "array<variant>"), lambda v: (kind(v) != "string") | _is(
                F.try_variant_get(v, "$", "string") == ""))
            rule = rule.when(odd, "R18_label_type")
        found.append(F.when(table & rule.isNotNull(), F.struct(F.concat(base, F.lit(f".{key}")).alias("path"),
                                                               F.lit(n).alias("rule_no"), rule.alias("rule_id"))))
    return (size_classes(documents, keys).select(*keys, F.explode(F.array_compact(F.array(*found))).alias("v"))
            .select(*keys, "v.path", "v.rule_no", "v.rule_id"))


def class_table(documents: DataFrame, profile: str) -> DataFrame:
    """The flat class table of :func:`.rules.class_rule_violations`; a value of another type is null."""
    at = lambda key: F.try_variant_get("item", f"$.{key}", "variant")
    text = lambda key: F.when(kind(at(key)) == "string", F.try_variant_get("item", f"$.{key}", "string"))
    number = lambda key: F.when(kind(at(key)) == "integer", F.try_variant_get("item", f"$.{key}", "bigint"))
    labels = F.array_join(F.try_variant_get("item", "$.labels", "array<string>"), ",")
    return size_classes(documents, [profile]).select(
        F.col(profile).alias("profile"), F.col("class_pos").cast("long").alias("class_pos"), text("name").alias("name"),
        labels.alias("labels"), text("snapshot").alias("snapshot"), number("min_idle").alias("min_idle"),
        number("max").alias("max_live"), text("warm_floor_reason").alias("warm_floor_reason"))


def manifest_violations(manifests: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, path, rule_no, rule_id`` for fleet manifests as JSON text in ``body``.

    R1 version and at least one fleet; per entry of ``fleet``: a table, R4
    scope, R5 closed keys (they depend on the scope), R2 name, R3 owner, R9
    profile path and installation key, each present, of its type and form,
    the path the one that follows from the name; R2 and R3 uniqueness of the
    name and of the scope's owner within a manifest.
    """
    rows = read_documents(manifests)
    version, fleet = F.try_variant_get("doc", "$.manifest.version", "variant"), F.try_variant_get("doc", "$.fleet", "array<variant>")
    top = _findings(rows, keys, [
        (5, "R5_unreadable", "", F.col("doc").isNull()),
        (1, "R1_manifest_version", "manifest.version", F.col("doc").isNotNull() & ~_is(
            (kind(version) == "integer") & (F.try_variant_get("doc", "$.manifest.version", "bigint") == 1))),
        (1, "R1_no_fleet", "fleet", F.col("doc").isNotNull() & ~_is(F.size(fleet) > 0))])
    item = F.col("item")
    text = lambda key: F.when(kind(F.try_variant_get(item, f"$.{key}", "variant")) == "string",
                              F.try_variant_get(item, f"$.{key}", "string"))
    scope = F.when(F.try_variant_get(item, "$.scope", "variant").isNull(), "organization").otherwise(text("scope"))
    owners = OWNER_KEYS["manifest"]
    owner = F.when(scope == "organization", text(owners["organization"])).otherwise(text(owners["repository"]))
    names = F.map_keys(F.try_variant_get(item, "$", "map<string,variant>"))
    entries = (rows.select(*keys, F.posexplode(fleet).alias("pos", "item"))
               .select(*keys, "pos", F.explode(F.array(F.struct(
                   kind(item).alias("type"), names.alias("names"), scope.alias("scope"), owner.alias("owner"), text("name").alias("name"),
                   text("profile").alias("profile"), text("installation_id_key").alias("installation")))).alias("e"))
               .select(*keys, "pos", "e.*"))
    c = F.col
    known = c("scope").isin(*SCOPES)
    table = c("type") == "object"
    allowed = F.when(c("scope") == "organization", F.array(*map(F.lit, (*MANIFEST_KEYS, owners["organization"])))).otherwise(
        F.array(*map(F.lit, (*MANIFEST_KEYS, owners["repository"]))))
    rules = [
        (1, "R1_entry_type", "", ~table),
        (4, "R4_scope", ".scope", table & ~_is(known)),
        (2, "R2_fleet_name", ".name", table & ~_full(c("name"), FLEET_NAME)),
        (3, "R3_owner_name", ".owner", table & _is(known) & ~_full(c("owner"), OWNER_NAME)),
        (9, "R9_profile_path", ".profile", table & ~_is(c("profile") == F.concat(
            F.lit("config/fleets/"), c("name"), F.lit("/runners.toml")))),
        (9, "R9_installation_key", ".installation_id_key", table & ~_full(c("installation"), r"^[1-9][0-9]*$")),
    ]
    base = F.concat(F.lit("fleet["), c("pos").cast("string"), F.lit("]"))
    named = _findings(entries, [*keys, "pos"], rules).withColumn("path", F.concat(base, "path")).drop("pos")
    extra = (entries.where(table & known).select(*keys, "pos", F.explode(F.array_except("names", allowed)).alias("key"))
             .select(*keys, F.concat(base, F.lit("."), "key").alias("path"), F.lit(5).alias("rule_no"),
                     F.lit("R5_unknown_key").alias("rule_id")))

    def repeated(by: list[Column], n: int, rule: str, path: str) -> DataFrame:
        seen = entries.where(table).select(*keys, "pos", F.struct(*by).alias("by"))
        first = seen.groupBy(*keys, "by").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
        first = first.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("by").alias("_by"), "first")
        same = " AND ".join([f"`{k}` <=> `_{k}`" for k in keys] + ["by <=> _by", "pos > first"])
        return seen.join(first, F.expr(same)).select(
            *keys, F.concat(base, F.lit(path)).alias("path"), F.lit(n).alias("rule_no"), F.lit(rule).alias("rule_id"))

    names_twice = repeated([c("name")], 2, "R2_fleet_unique", ".name")
    owners_twice = repeated([c("scope"), F.lower("owner").alias("owner")], 3, "R3_scope_owner_unique", ".owner")
    return top.unionByName(named).unionByName(extra).unionByName(names_twice).unionByName(owners_twice)
