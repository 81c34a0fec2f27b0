"""Demand, supply and the spawn plan.

Everything is keyed joins and grouped counts; the only window (W2) is
partitioned by size class over the configured repository order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .labels import match_class
from ..fixed import MAX_LIVE_DEFAULT  # noqa: F401

RUN_LISTINGS = ("queued", "in_progress")
SUPPLY_STATES = ("SPAWNING",)


def queued_jobs(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Queued jobs of runs listed as queued or in progress.

    A run listed under both statuses contributes its jobs twice, exactly as
    the two listings are concatenated.  Equi-join on (repository, run_id);
    the run filter is pushed to the scan.
    """
    listed = runs.filter(F.col("status").isin(*RUN_LISTINGS)).select("repository", "run_id")
    return (listed.join(jobs.filter(F.col("status") == "queued"), ["repository", "run_id"]))


def busy_lookup(registry: DataFrame, runners: DataFrame) -> DataFrame:
    """Registry rows with the runner's busy flag (missing -> false).

    The key is (runner_id, repository) where repository may be null (an
    organisation runner), so the join is null-safe; Spark still plans it as
    a hash/sort-merge equi-join.
    """
    r = runners.select(F.col("runner_id").alias("_rid"), F.col("repository").alias("_rrepo"),
                       F.col("busy").alias("_busy"))
    cond = (registry["runner_id"].eqNullSafe(r["_rid"])) & (registry["repository"].eqNullSafe(r["_rrepo"]))
    return (registry.join(r, cond, "left")
            .select(*[registry[c] for c in registry.columns],
                    F.coalesce(F.col("_busy"), F.lit(False)).alias("busy")))


def _matched(jobs: DataFrame, classes: DataFrame, required: list[str] | None) -> DataFrame:
    return match_class(jobs, classes, required=required).filter(F.col("size_class").isNotNull())


def demand_by_class(jobs: DataFrame, classes: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Matched queued-job count per class, zero-filled over all classes."""
    counts = _matched(jobs, classes, required).groupBy("size_class").agg(F.count(F.lit(1)).alias("queued"))
    return (classes.select(F.col("name").alias("size_class"))
            .join(counts, "size_class", "left")
            .select("size_class", F.coalesce("queued", F.lit(0)).alias("queued")))


def demand_by_repo_class(jobs: DataFrame, classes: DataFrame, repos: DataFrame,
                         required: list[str] | None = None) -> DataFrame:
    """A10: matched count per (configured repository, class), zero-filled.

    The zero-fill grid is the result itself: every configured repository
    with every size class.
    """
    counts = (_matched(jobs, classes, required)
              .groupBy("repository", "size_class").agg(F.count(F.lit(1)).alias("queued")))
    names = classes.agg(F.collect_list("name").alias("_names"))  # one row
    grid = repos.select("repository").crossJoin(names).select("repository", F.explode("_names").alias("size_class"))
    return (grid.join(counts, ["repository", "size_class"], "left")
            .select("repository", "size_class", F.coalesce("queued", F.lit(0)).alias("queued")))


def _is_supply():
    return (F.col("state") == "SPAWNING") | ((F.col("state") == "IDLE") & ~F.col("busy"))


def supply_and_live(registry_busy: DataFrame, by_repo: bool = False) -> DataFrame:
    """Supply (SPAWNING, or IDLE and not busy) and live (all) per class,
    or per (repository, class) for repository scope."""
    keys = ["repository", "cls_name"] if by_repo else ["cls_name"]
    return (registry_busy.groupBy(*keys)
            .agg(F.count_if(_is_supply()).alias("supply"), F.count(F.lit(1)).alias("live"))
            .withColumnRenamed("cls_name", "size_class"))


def registry_status(registry: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Total live cycles and BUSY cycles."""
    keys = keys or []
    return registry.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"),
                                       F.count_if(F.col("state") == "BUSY").alias("busy"))


def spawn_plan_org(demand: DataFrame, supply: DataFrame, classes: DataFrame) -> DataFrame:
    """Per class, ``to_spawn = min(max(q - s, floor - s, 0), max(max - live, 0))``
    and ``floor_slots = max(min(floor - s, to_spawn), 0)``."""
    c = classes.select(F.col("name").alias("size_class"),
                       F.coalesce(F.col("min_idle"), F.lit(0)).alias("min_idle"),
                       F.coalesce(F.col("max_live").cast("long"), F.lit(MAX_LIVE_DEFAULT)).alias("max_live"))
    j = (c.join(demand, "size_class", "left").join(supply, "size_class", "left")
         .select("size_class", F.coalesce("queued", F.lit(0)).alias("queued"),
                 F.coalesce("supply", F.lit(0)).alias("supply"), F.coalesce("live", F.lit(0)).alias("live"),
                 "min_idle", "max_live"))
    want = F.greatest(F.col("queued") - F.col("supply"), F.col("min_idle") - F.col("supply"), F.lit(0))
    room = F.greatest(F.col("max_live") - F.col("live"), F.lit(0))
    to_spawn = F.least(want, room)
    return (j.withColumn("to_spawn", to_spawn.cast("long"))
            .withColumn("floor_slots",
                        F.greatest(F.least(F.col("min_idle") - F.col("supply"), F.col("to_spawn")), F.lit(0))
                        .cast("long")))


def spawn_plan_repo(demand: DataFrame, supply: DataFrame, classes: DataFrame, repos: DataFrame) -> DataFrame:
    """Share each class's remaining cap over repositories in configured order.

    ``to_spawn_i = min(deficit_i, max(avail - sum(deficit_j, j < i), 0))``,
    which equals the greedy loop; ``avail = max(max - live_class, 0)``.
    The window is partitioned by class; one partition holds that class's
    configured repositories only.
    """
    live_cls = supply.groupBy("size_class").agg(F.sum("live").alias("class_live"))
    c = (classes.select(F.col("name").alias("size_class"),
                        F.coalesce(F.col("max_live").cast("long"), F.lit(MAX_LIVE_DEFAULT)).alias("max_live"))
         .join(live_cls, "size_class", "left")
         .select("size_class", F.greatest(F.col("max_live") - F.coalesce("class_live", F.lit(0)), F.lit(0))
                 .alias("available")))
    d = (demand.join(repos.select("repository", "repo_pos"), "repository")
         .join(supply.select("repository", "size_class", "supply"), ["repository", "size_class"], "left")
         .join(c, "size_class")
         .withColumn("deficit", F.greatest(F.col("queued") - F.coalesce("supply", F.lit(0)), F.lit(0))))
    w = Window.partitionBy("size_class").orderBy("repo_pos").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("deficit").over(w), F.lit(0))
    return d.select("repository", "size_class", "queued", F.coalesce("supply", F.lit(0)).alias("supply"),
                    "deficit", "available",
                    F.least(F.col("deficit"), F.greatest(F.col("available") - before, F.lit(0)))
                    .cast("long").alias("to_spawn"))


def spawn_slots(plan: DataFrame, idle_refresh_secs: int, demand_idle_secs: int,
                keys: list[str] | None = None) -> DataFrame:
    """One row per slot to spawn; the first ``floor_slots`` slots refresh
    the warm floor, the rest serve demand.  ``to_spawn`` is bounded by the
    class cap, so the explode is bounded too."""
    keys = keys or ["size_class"]
    floor = F.col("floor_slots") if "floor_slots" in plan.columns else F.lit(0)
    slots = plan.filter(F.col("to_spawn") > 0).select(
        *keys, floor.alias("_floor"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("to_spawn") - 1)).alias("slot"))
    return slots.select(*keys, "slot",
                        F.when(F.col("slot") < F.col("_floor"), F.lit(idle_refresh_secs))
                        .otherwise(F.lit(demand_idle_secs)).alias("idle_deadline_secs"))
