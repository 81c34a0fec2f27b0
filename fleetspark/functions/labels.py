"""Label-map and label-list predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import (NETWORK_POLICY, PROJECT, PROVIDER_LABEL, Project, RUNNER_ROLE,  # noqa: F401
                     SCOPE_ORGANIZATION, SCOPE_REPOSITORY)


def label_map(**cols: Column) -> Column:
    """P25: attribution map from named columns, dropping null values."""
    pairs = []
    for k, v in cols.items():
        pairs += [F.lit(k), v.cast("string")]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def fleet_sandbox(labels: Column, scope: str, owner: str, fleet: str) -> Column:
    """A sandbox belongs to this fleet.

    Repository scope: labels scope='repository' and fleet equal.  Organization
    scope: org equals lower(owner) and scope is not 'repository' (absent
    scope allowed).
    """
    role_ok = F.coalesce(labels["role"] == RUNNER_ROLE, F.lit(False))
    if scope == SCOPE_REPOSITORY:
        own = (labels["scope"] == SCOPE_REPOSITORY) & (labels["fleet"] == fleet)
    else:
        own = (labels["org"] == owner.lower()) & (F.coalesce(labels["scope"], F.lit("")) != SCOPE_REPOSITORY)
    return role_ok & F.coalesce(own, F.lit(False))


def fleet_runner(labels: Column, scope: str, fleet: str, project: Project = PROJECT) -> Column:
    """Organization scope keeps every runner; repository scope requires
    the exact label of the project's fleet prefix and ``fleet``.  ``labels`` is array<struct<name>>."""
    if scope != SCOPE_REPOSITORY:
        return F.lit(True)
    return F.coalesce(F.exists(labels, lambda l: l["name"] == project.fleet_label_prefix + fleet), F.lit(False))


def has_label(labels: Column, name: str) -> Column:
    return F.coalesce(F.exists(labels, lambda l: l["name"] == name), F.lit(False))


def base_labels(scope: Column, org: Column, fleet: Column, network_policy: Column,
                size_class: Column, repository: Column) -> Column:
    """P25: sandbox attribution labels: role and org always; scope and fleet
    for repository scope; the network policy when the profile restricts
    egress; size class and repository when set (non-empty)."""
    is_repo = scope == SCOPE_REPOSITORY
    restricted = network_policy == NETWORK_POLICY
    return label_map(role=F.lit(RUNNER_ROLE), org=F.lower(org),
                     scope=F.when(is_repo, scope), fleet=F.when(is_repo, fleet),
                     network_policy=F.when(restricted, F.lit(NETWORK_POLICY)),
                     size_class=F.nullif(size_class, F.lit("")), repository=F.nullif(repository, F.lit("")))
