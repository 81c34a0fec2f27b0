"""One reconcile pass as a plan table (nothing is spawned)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import demand as dm


def reconcile_org(runs: DataFrame, jobs: DataFrame, classes: DataFrame, registry: DataFrame,
                  runners: DataFrame, idle_refresh_secs: int, demand_idle_secs: int,
                  required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Organization scope: (per-class plan, one row per slot)."""
    demand = dm.demand_by_class(dm.queued_jobs(runs, jobs), classes, required)
    supply = dm.supply_and_live(dm.busy_lookup(registry, runners))
    plan = dm.spawn_plan_org(demand, supply, classes)
    return plan, dm.spawn_slots(plan, idle_refresh_secs, demand_idle_secs)


def reconcile_repos(runs: DataFrame, jobs: DataFrame, classes: DataFrame, registry: DataFrame,
                    runners: DataFrame, repos: DataFrame, demand_idle_secs: int,
                    required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Repository scope: supply never crosses repositories; the class cap is
    shared greedily in configured order.  (plan per repo x class, slots)."""
    demand = dm.demand_by_repo_class(dm.queued_jobs(runs, jobs), classes, repos, required)
    supply = dm.supply_and_live(dm.busy_lookup(registry, runners), by_repo=True)
    plan = dm.spawn_plan_repo(demand, supply, classes, repos)
    return plan, dm.spawn_slots(plan, demand_idle_secs, demand_idle_secs, ["repository", "size_class"])
