"""Fleet health findings.

Every check is a keyed anti/left join or a grouped count.  Name keys
compare case-insensitively (``lower``) but keep the display name.  A
finding row is (instance, check, entity, text) so checks union by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import PROJECT, Project
from ..functions.core import floor_minutes, queue_wait_secs, sandbox_age_secs
from ..functions.labels import (PROVIDER_LABEL, SCOPE_ORGANIZATION,
                                fleet_runner, fleet_sandbox, has_label)
from .labels import match_class
from .topk import joined_top_global
from ..fixed import ID_CHARS, ID_TOP, MESSAGE_TOP, ORPHAN_SWEEP_GRACE_SECS  # noqa: F401

FINDING_COLS = ("instance", "check", "entity", "text")


def normalize_roster(repos: DataFrame, owner: str, private_only: bool = False) -> DataFrame:
    """App-visible repositories of ``owner`` (case-insensitive); with
    ``private_only`` only rows whose private flag is exactly true."""
    ok = (F.col("name").isNotNull() & F.col("owner_login").isNotNull()
          & (F.lower("owner_login") == owner.lower()))
    if private_only:
        ok = ok & F.coalesce(F.col("private") == F.lit(True), F.lit(False))
    return repos.filter(ok)


def lower_key_roster(names: DataFrame, name_col: str = "name", pos_col: str | None = None) -> DataFrame:
    """(key=lower(name), name); duplicates by key keep the last by
    ``pos_col`` (listing order), or without one the greatest spelling, so
    the choice is deterministic under retries."""
    if pos_col is None:
        return names.groupBy(F.lower(name_col).alias("key")).agg(F.max(name_col).alias("name"))
    return (names.groupBy(F.lower(name_col).alias("key"))
            .agg(F.max_by(name_col, pos_col).alias("name")))


def selected_not_visible(group_roster: DataFrame, visible_roster: DataFrame) -> DataFrame:
    """Repositories the runner group selects that the App cannot see."""
    return group_roster.join(visible_roster.select("key"), "key", "left_anti")


def private_uncovered(visible_private: DataFrame, group_roster: DataFrame) -> DataFrame:
    """Private visible repositories outside the runner group."""
    return visible_private.join(group_roster.select("key"), "key", "left_anti")


def profile_roster_diff(configured: DataFrame, private_roster: DataFrame) -> DataFrame:
    """(kind, name): configured but not privately visible ('missing'),
    privately visible but not configured ('unconfigured')."""
    missing = configured.join(private_roster.select("key"), "key", "left_anti").withColumn("kind", F.lit("missing"))
    extra = private_roster.join(configured.select("key"), "key", "left_anti").withColumn("kind", F.lit("unconfigured"))
    return missing.unionByName(extra).select("kind", "key", "name")


def _fill(template: str, value: Column) -> Column:
    """``template`` with its single ``%s`` replaced by ``value`` (literal parts
    are never read as a format string)."""
    before, _, after = template.partition("%s")
    return F.concat(F.lit(before), value, F.lit(after))


def roster_finding(rows: DataFrame, instance: str, check: str, template: str) -> DataFrame:
    """One finding per non-empty list: the first 10 names (sorted) joined."""
    joined = joined_top_global(rows.select("name"), "name", MESSAGE_TOP)
    return joined.select(F.lit(instance).alias("instance"), F.lit(check).alias("check"),
                         F.lit("").alias("entity"),
                         _fill(template, F.col("names")).alias("text"))


def orphan_sandboxes(sandboxes: DataFrame, live_ids: DataFrame, as_of: str, scope: str, owner: str,
                     fleet: str, grace_secs: int = ORPHAN_SWEEP_GRACE_SECS) -> DataFrame:
    """Fleet sandboxes the registry does not track, older than the grace
    period; an unknown age counts as an orphan.  ``sandboxes`` has
    (sandbox_id, labels map, created_at text); ``live_ids`` has sandbox_id."""
    mine = sandboxes.filter(fleet_sandbox(F.col("labels"), scope, owner, fleet))
    age = sandbox_age_secs("created_at", as_of)
    return (mine.join(live_ids.select("sandbox_id").filter(F.col("sandbox_id").isNotNull()), "sandbox_id", "left_anti")
            .withColumn("age_secs", age)
            .filter(F.col("age_secs").isNull() | (F.col("age_secs") >= grace_secs)))


def _stale_runner(scope: str, fleet: str, project: Project):
    return ((F.col("status") == "offline") & F.col("name").startswith(project.runner_name_prefix)
            & has_label(F.col("labels"), PROVIDER_LABEL) & fleet_runner(F.col("labels"), scope, fleet, project))


def orphan_runners(runners: DataFrame, live: DataFrame, scope: str, fleet: str, project: Project = PROJECT) -> DataFrame:
    """Offline runners named with the fleet prefix, labelled for the provider (and fleet)
    that no live cycle owns.  Null-safe anti-join on (runner_id, repository)."""
    cand = runners.filter(_stale_runner(scope, fleet, project))
    l = live.select(F.col("runner_id").alias("_lid"), F.col("repository").alias("_lrepo")).filter(
        F.col("_lid").isNotNull())
    cond = cand["runner_id"].eqNullSafe(l["_lid"]) & cand["repository"].eqNullSafe(l["_lrepo"])
    return cand.join(l, cond, "left_anti")


def reap_candidates(runners: DataFrame, sandboxes: DataFrame, scope: str, owner: str, fleet: str,
                    project: Project = PROJECT) -> DataFrame:
    """The startup reap view, (kind, id): stale runners and every fleet
    sandbox, with no registry and no grace period."""
    r = runners.filter(_stale_runner(scope, fleet, project)).select(
        F.lit("runner").alias("kind"), F.col("runner_id").cast("string").alias("id"))
    s = sandboxes.filter(fleet_sandbox(F.col("labels"), scope, owner, fleet)).select(
        F.lit("sandbox").alias("kind"), F.col("sandbox_id").alias("id"))
    return r.unionByName(s)


def stuck_jobs(jobs: DataFrame, classes: DataFrame, group_roster: DataFrame | None, as_of: str,
               stuck_after_secs: int, scope: str, owner: str, group_name: str, instance: str,
               required: list[str] | None = None) -> DataFrame:
    """Fleet jobs (class-matched) queued at least ``stuck_after_secs``.

    Organization scope: a repository outside the runner group gives kind
    ``never_reachable``; otherwise ``waiting``.  Jobs whose creation time
    does not parse are skipped.
    """
    m = match_class(jobs, classes, required=required).filter(F.col("size_class").isNotNull())
    is_text = dict(jobs.dtypes).get("created_at") == "string"
    waited = queue_wait_secs("created_at", as_of, text=is_text)
    m = m.withColumn("waited_secs", waited).filter(F.col("waited_secs").isNotNull()
                                                   & (F.col("waited_secs") >= stuck_after_secs))
    if scope == SCOPE_ORGANIZATION and group_roster is not None:
        g = group_roster.select(F.col("key").alias("_gkey"), F.lit(True).alias("_in_group"))
        m = m.join(g, F.lower("repository") == F.col("_gkey"), "left")
        kind = F.when(F.col("_in_group").isNull(), "never_reachable").otherwise("waiting")
    else:
        kind = F.lit("waiting")
    mins = floor_minutes("waited_secs")
    url = F.coalesce(F.col("html_url"), F.lit("")) if "html_url" in jobs.columns else F.lit("")
    head = F.concat(F.lit(f"[{instance}] {owner}/"), F.col("repository"), F.lit(": job queued "),
                    mins.cast("string"), F.lit("m"))
    text = F.when(kind == "never_reachable", F.concat(
        head, F.lit(f" but the repo is NOT in runner group '{group_name}' — jobs will queue forever until it is added"))
    ).otherwise(F.concat(head, F.lit(" — "), url))
    return m.select("job_id", "repository", "size_class", kind.alias("kind"), mins.alias("minutes"), text.alias("text"))


def sandbox_cap(sandboxes: DataFrame, max_sandboxes: int, scope: str, owner: str, fleet: str,
                instance: str) -> DataFrame:
    """One finding when fleet sandboxes exceed the cap (0 disables)."""
    if not max_sandboxes:
        return sandboxes.sparkSession.createDataFrame([], "instance string, check string, entity string, text string")
    mine = sandboxes.filter(fleet_sandbox(F.col("labels"), scope, owner, fleet))
    n = mine.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_sandboxes)
    return n.select(F.lit(instance).alias("instance"), F.lit("sandbox_cap").alias("check"), F.lit("").alias("entity"),
                    F.concat(F.lit(f"[{instance}] "), F.col("n").cast("string"),
                             F.lit(f" fleet-labeled sandboxes exceed the configured max of {max_sandboxes}")).alias("text"))


def old_sandboxes(sandboxes: DataFrame, as_of: str, limit_secs: int, scope: str, owner: str, fleet: str,
                  instance: str, order_col: str = "sandbox_id") -> DataFrame:
    """Fleet sandboxes older than the limit (unknown age is not old):
    count plus the first five 8-character ids."""
    mine = sandboxes.filter(fleet_sandbox(F.col("labels"), scope, owner, fleet))
    old = mine.filter(F.coalesce(sandbox_age_secs("created_at", as_of), F.lit(0.0)) > limit_secs)
    n = old.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0)
    ids = joined_top_global(old.select(F.col(order_col).alias("_o"), F.substring("sandbox_id", 1, ID_CHARS).alias("id8")),
                            "id8", ID_TOP, order=[F.col("_o")], out_col="ids")
    return n.crossJoin(ids).select(
        F.lit(instance).alias("instance"), F.lit("old_sandboxes").alias("check"), F.lit("").alias("entity"),
        F.concat(F.lit(f"[{instance}] "), F.col("n").cast("string"),
                 F.lit(f" sandbox(es) older than {limit_secs // 60}m still running — possible orphans: "),
                 F.col("ids")).alias("text"))


def group_id_consistency(repo_groups: DataFrame, group_name: str) -> DataFrame:
    """Per repository, how many groups carry the configured name (must
    be exactly one), and how many distinct ids those groups have overall.

    ``repo_groups`` has (repository, group_id, group_name).  Output rows:
    (repository, matches, ok) plus the fleet-wide ``distinct_ids``.
    """
    named = repo_groups.filter((F.col("group_name") == group_name) & F.col("group_id").isNotNull())
    per_repo = (repo_groups.select("repository").distinct()
                .join(named.groupBy("repository").agg(F.count(F.lit(1)).alias("matches")), "repository", "left")
                .select("repository", F.coalesce("matches", F.lit(0)).alias("matches")))
    ids = (named.join(per_repo.filter(F.col("matches") == 1), "repository", "left_semi")
           .agg(F.count_distinct("group_id").alias("distinct_ids")))
    return per_repo.crossJoin(F.broadcast(ids)).select(
        "repository", "matches", (F.col("matches") == 1).alias("ok"), "distinct_ids")


def group_id_available(repo_groups: DataFrame, group_id: int) -> DataFrame:
    """A18 with a configured id: per repository, whether a group of that id is
    available to it.  Output (repository, ok)."""
    hit = F.coalesce(F.col("group_id") == F.lit(group_id), F.lit(False))
    return repo_groups.groupBy("repository").agg(F.bool_or(hit).alias("ok"))


def inactive_units(instances: DataFrame) -> DataFrame:
    """Findings for instances whose unit is set but not active; their other
    checks are skipped, see ``active_instances``."""
    down = instances.filter((F.coalesce(F.col("unit"), F.lit("")) != "") & ~F.coalesce(F.col("active"), F.lit(False)))
    return down.select("instance", F.lit("unit").alias("check"), F.col("unit").alias("entity"),
                       F.concat(F.lit("["), F.col("instance"), F.lit("] systemd unit "), F.col("unit"),
                                F.lit(" is NOT active")).alias("text"))


def active_instances(instances: DataFrame) -> DataFrame:
    """Instances to check: without a unit, or with an active one."""
    return instances.filter((F.coalesce(F.col("unit"), F.lit("")) == "") | F.coalesce(F.col("active"), F.lit(False)))


def installation_findings(instances: DataFrame) -> DataFrame:
    """Findings for organization installations that see selected repositories
    only (``repository_selection`` other than 'all', or unknown)."""
    bad = instances.filter((F.col("scope") == SCOPE_ORGANIZATION)
                           & ~F.coalesce(F.col("repository_selection") == "all", F.lit(False)))
    return bad.select("instance", F.lit("installation").alias("check"), F.lit("").alias("entity"),
                      F.concat(F.lit("["), F.col("instance"),
                               F.lit("] the app installation does not cover all repositories")).alias("text"))


def selected_group_check(groups: DataFrame) -> DataFrame:
    """Per group name, how many groups carry it and whether it is usable:
    exactly one group, integer id, visibility 'selected' and
    allows_public_repositories exactly false (null fails)."""
    good = (F.col("id").isNotNull() & (F.col("visibility") == "selected")
            & F.coalesce(F.col("allows_public_repositories") == F.lit(False), F.lit(False)))
    return (groups.filter(F.col("name").isNotNull()).groupBy("name")
            .agg(F.count(F.lit(1)).alias("matches"), F.bool_and(good).alias("_good"))
            .select("name", "matches", ((F.col("matches") == 1) & F.col("_good")).alias("ok")))


def group_selection_check(groups: DataFrame, selected: DataFrame, visible: DataFrame, group_name: str) -> DataFrame:
    """What keeps an organization's runner group from being used, as
    (rule_id, detail): the named group (the one of least id, if several) has
    to exist, select repositories and not allow public ones; it must have
    repositories selected (``selected.name``), all visible to the app
    (``visible.key``, lower-cased).  No row: usable."""
    one = groups.filter(F.col("name") == group_name).agg(
        F.min(F.struct(F.col("id").isNull().alias("_n"), "id", "visibility", "allows_public_repositories")).alias("g"))
    usable = F.coalesce((F.col("g.visibility") == "selected") & (F.col("g.allows_public_repositories") == F.lit(False)), F.lit(False))
    group = one.filter(~usable).select(F.lit("R25_group").alias("rule_id"), F.lit(group_name).alias("detail"))
    none = selected.agg(F.count("name").alias("n")).filter("n = 0").select(
        F.lit("R25_no_repositories").alias("rule_id"), F.lit(group_name).alias("detail"))
    unseen = (selected.filter(F.col("name").isNotNull()).join(visible.select("key"), F.lower("name") == F.col("key"), "left_anti")
              .select(F.lit("R25_not_visible").alias("rule_id"), F.col("name").alias("detail")))
    return group.unionByName(none).unionByName(unseen)


def all_findings(*checks: DataFrame) -> DataFrame:
    """Union of per-check findings (instance, check, entity, text)."""
    out = None
    for c in checks:
        c = c.select(*FINDING_COLS)
        out = c if out is None else out.unionByName(c)
    return out


def repo_scope_findings(configured: DataFrame, private_roster: DataFrame, repo_groups: DataFrame,
                        group_name: str | None, instance: str, owner: str, group_id: int | None = None) -> DataFrame:
    """Repository-scope watchdog findings: the roster difference (J7) as two
    list findings, one finding per configured repository the named runner
    group is not exactly once available to, and one when the group's id
    differs across repositories (A18)."""
    diff = profile_roster_diff(configured, private_roster)
    missing = roster_finding(diff.filter(F.col("kind") == "missing"), instance, "profile_missing",
                             f"[{instance}] repository profile includes private App "
                             "repository/repositories no longer visible: %s")
    extra = roster_finding(diff.filter(F.col("kind") == "unconfigured"), instance, "profile_unconfigured",
                           f"[{instance}] private App repository/repositories are not covered by "
                           "this repository profile: %s")
    if group_name is None:  # the profile names the group by id
        groups = repo_groups.join(configured.select(F.col("name").alias("repository")), "repository", "left_semi")
        lacking = group_id_available(groups, group_id).filter(~F.col("ok")).select(
            F.lit(instance).alias("instance"), F.lit("group_unavailable").alias("check"),
            F.col("repository").alias("entity"),
            F.concat(F.lit(f"[{instance}] configured runner group {group_id} is unavailable to {owner}/"),
                     F.col("repository")).alias("text"))
        return all_findings(missing, extra, lacking)
    cons = group_id_consistency(repo_groups.join(configured.select(F.col("name").alias("repository")),
                                                 "repository", "left_semi"), group_name)
    unavailable = cons.filter(~F.col("ok")).select(
        F.lit(instance).alias("instance"), F.lit("group_unavailable").alias("check"),
        F.col("repository").alias("entity"),
        F.concat(F.lit(f"[{instance}] configured runner group '{group_name}' is unavailable to {owner}/"),
                 F.col("repository")).alias("text"))
    inconsistent = cons.agg(F.max("distinct_ids").alias("d")).filter(F.col("d") > 1).select(
        F.lit(instance).alias("instance"), F.lit("group_inconsistent").alias("check"), F.lit("").alias("entity"),
        F.lit(f"[{instance}] configured runner group '{group_name}' has inconsistent IDs across repositories")
        .alias("text"))
    return all_findings(missing, extra, unavailable, inconsistent)
