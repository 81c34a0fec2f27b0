"""Configuration-table operators.

Configuration reaches Spark as small tables (a driver-side TOML load in
user code may build them); every check below is a join, a grouped count
or a per-row expression over those tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import PROVIDER_API_BASE  # noqa: F401


def flatten_profile_refs(fleets: DataFrame, profile_classes: DataFrame) -> DataFrame:
    """One (snapshot, fleet, profile, size_class) row per class of each
    fleet's profile, ordered by (fleet, size_class, profile)."""
    return (fleets.select("fleet", "profile")
            .join(profile_classes.select("profile", F.col("name").alias("size_class"), "snapshot"), "profile")
            .select("snapshot", "fleet", "profile", "size_class").orderBy("fleet", "size_class", "profile", "snapshot"))


def target_available(fleets: DataFrame, regions: DataFrame) -> DataFrame:
    """Whether each fleet's target is a region id **or** name.

    The OR-join becomes an equi-join: regions are exploded into their two
    keys (distinct), then left-joined on the target."""
    keys = (regions.select(F.explode(F.array(F.col("id"), F.col("name"))).alias("_key"))
            .filter(F.col("_key").isNotNull()).distinct().withColumn("_hit", F.lit(True)))
    return (fleets.join(keys, fleets["target"] == keys["_key"], "left")
            .select("fleet_pos", "fleet", "target", F.coalesce("_hit", F.lit(False)).alias("available")))


def first_failing_rule(checks: DataFrame, entity: list[str]) -> DataFrame:
    """The first failed rule (lowest rule_no, then rule id) per entity;
    checks has (entity..., rule_no, rule, failed)."""
    return (checks.filter("failed").groupBy(*entity)
            .agg(F.min_by("rule", F.struct("rule_no", "rule")).alias("rule"), F.min("rule_no").alias("rule_no")))


def repo_visibility_check(configured: DataFrame, visible: DataFrame, repo_groups: DataFrame,
                          group_name: str) -> DataFrame:
    """Per configured repository, the first failing preflight rule:
    1 not visible to the App, 2 not private, 3 the named group is not
    exactly once available.  Repositories passing all rules are absent."""
    vis = visible.select(F.col("key").alias("_k"), F.col("private").alias("_private"))
    groups = (repo_groups.filter((F.col("group_name") == group_name) & F.col("group_id").isNotNull())
              .groupBy(F.lower("repository").alias("_gk")).agg(F.count(F.lit(1)).alias("_matches")))
    base = (configured.select("repository", F.lower("repository").alias("_key"))
            .join(vis, F.col("_key") == F.col("_k"), "left")
            .join(groups, F.col("_key") == F.col("_gk"), "left"))
    checks = base.select("repository", F.explode(F.array(
        F.struct(F.lit(1).alias("rule_no"), F.lit("not_visible").alias("rule"), F.col("_k").isNull().alias("failed")),
        F.struct(F.lit(2).alias("rule_no"), F.lit("not_private").alias("rule"),
                 (~F.coalesce(F.col("_private") == F.lit(True), F.lit(False))).alias("failed")),
        F.struct(F.lit(3).alias("rule_no"), F.lit("group_unavailable").alias("rule"),
                 (F.coalesce(F.col("_matches"), F.lit(0)) != 1).alias("failed")),
    )).alias("c")).select("repository", "c.*")
    return first_failing_rule(checks, ["repository"])


def desired_state_diff(actual: DataFrame, desired: DataFrame, key: str, attrs: list[str],
                       delete_scope=None) -> DataFrame:
    """Create / update / keep / delete / ignore per key.

    ``delete_scope`` (a Column over the actual side) limits what may be
    deleted (rulesets: only branch-target repository rules); actual rows
    outside it that are not desired are 'ignore'.
    """
    a = actual.select(F.col(key).alias("_ka"), *[F.col(c).alias("a_" + c) for c in attrs],
                      (delete_scope if delete_scope is not None else F.lit(True)).alias("_deletable"))
    d = desired.select(F.col(key).alias("_kd"), *[F.col(c).alias("d_" + c) for c in attrs])
    j = a.join(d, F.col("_ka") == F.col("_kd"), "full_outer")
    differs = F.lit(False)
    for c in attrs:
        differs = differs | ~F.col("a_" + c).eqNullSafe(F.col("d_" + c))
    action = (F.when(F.col("_ka").isNull(), "create").when(F.col("_kd").isNull(),
                                                          F.when(F.col("_deletable"), "delete").otherwise("ignore"))
              .when(differs, "update").otherwise("keep"))
    return j.select(F.coalesce("_ka", "_kd").alias(key), action.alias("action"))


def canonical(body: Column) -> Column:
    """A nested rule body (VARIANT) as text that does not depend on the order of keys or list entries.

    Every leaf becomes ``path=value`` with list places left out of the path,
    and the leaves are sorted, repeats kept.  Bodies with the same leaves
    under the same paths are the same; numbers compare by value.
    """
    return F.array_join(F.array_sort(_leaves(body, DEPTH)), "\n")


#: Levels of nesting that a rule body may have; deeper ones compare as their JSON text.
DEPTH = 5


def _leaves(v: Column, depth: int) -> Column:
    kind = F.schema_of_variant(v)
    leaf = F.array(F.concat(F.lit("="), F.coalesce(F.variant_get(v, "$", "string"), F.lit("null"))))
    if not depth:
        return leaf
    named = F.try_variant_get(v, "$", "map<string, variant>")
    listed = F.try_variant_get(v, "$", "array<variant>")
    from_map = F.flatten(F.transform(F.map_entries(named), lambda e: F.transform(
        _leaves(e["value"], depth - 1), lambda x: F.concat(F.lit("."), e["key"], x))))
    from_list = F.flatten(F.transform(listed, lambda e: F.transform(_leaves(e, depth - 1), lambda x: F.concat(F.lit("[]"), x))))
    empty = F.array(F.lit("={}"))
    return (F.when(v.isNull(), F.array(F.lit("=null"))).when(kind.startswith("OBJECT"), F.when(F.size(named) == 0, empty).otherwise(from_map))
            .when(kind.startswith("ARRAY"), F.when(F.size(listed) == 0, F.array(F.lit("=[]"))).otherwise(from_list)).otherwise(leaf))


def policy_diff(actual: DataFrame, desired: DataFrame, key: str = "name", type_col: str = "type", body_col: str = "body") -> DataFrame:
    """J17 for policies: the actions that bring ``actual`` to ``desired``, in ``step`` order.

    Bodies are JSON text and compare by :func:`canonical`.  A policy whose
    type differs cannot be changed in place: it is deleted (step 1) and
    created anew (step 2).  One with another body is updated, one that is
    not desired deleted, and an equal one kept.
    """
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(F.col(key).alias(p + "k"), F.col(type_col).alias(p + "t"), canonical(F.parse_json(F.col(body_col))).alias(p + "b"))

    j = side(actual, "a_").join(side(desired, "d_"), F.col("a_k") == F.col("d_k"), "full_outer")
    step = lambda n, name: F.struct(F.lit(n).alias("step"), F.lit(name).alias("action"))
    steps = (F.when(F.col("a_k").isNull(), F.array(step(1, "create"))).when(F.col("d_k").isNull(), F.array(step(1, "delete")))
             .when(~F.col("a_t").eqNullSafe(F.col("d_t")), F.array(step(1, "delete"), step(2, "create")))
             .when(~F.col("a_b").eqNullSafe(F.col("d_b")), F.array(step(1, "update"))).otherwise(F.array(step(1, "keep"))))
    return j.select(F.coalesce("a_k", "d_k").alias(key), F.explode(steps).alias("s")).select(key, "s.step", "s.action")


def volume_lookup(wanted: DataFrame, volumes: DataFrame, name_col: str = "cache_volume") -> DataFrame:
    """The first volume (by listing position) carrying each wanted name, else null."""
    first = volumes.groupBy(F.col("name").alias("_vname")).agg(F.min_by("id", "pos").alias("volume_id"))
    return wanted.join(first, wanted[name_col] == first["_vname"], "left").drop("_vname")


def single_api_base(fleets: DataFrame) -> DataFrame:
    """The normalised API base (no trailing '/') must be one value
    across profiles."""
    base = F.regexp_replace("api_base", "/+$", "")
    return fleets.agg(F.count_distinct(base).alias("distinct_bases")).select(
        "distinct_bases", (F.col("distinct_bases") == 1).alias("ok"))
