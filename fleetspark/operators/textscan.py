"""Workflow text scans (P21-P23, A24): line regexes over many repositories.

Lines are rows (``spark.read.text`` + ``input_file_name`` for files), so a
scan is a filter/projection; the report is one grouped count with a rollup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import (FORBIDDEN_NAMES, PINNED_REF, PROJECT, PROVIDER_LABEL, Project,  # noqa: F401
                     RUNS_ON_LINE, RUNS_ON_TARGET, SKIP_PLATFORMS, USES_LINE)


def _strip_quotes(c: Column) -> Column:
    return F.regexp_replace(c, r"^['\"]+|['\"]+$", "")


def should_rewrite(val: Column, project: Project = PROJECT) -> Column:
    """P21 rule: expressions and already-retargeted values stay; arrays are
    retargeted when a self-hosted or project label or a rewritable scalar
    appears and no
    Windows/macOS label; scalars when they match the rewritable pattern."""
    v = F.trim(val)
    is_array = v.startswith("[") & v.endswith("]")
    inner = F.transform(F.split(F.substring(v, F.lit(2), F.length(v) - 2), ","),
                        lambda x: _strip_quotes(F.trim(x)))
    array_rule = (~F.exists(inner, lambda x: x.isin(*SKIP_PLATFORMS))
                  & F.exists(inner, lambda x: x.isin(*project.rewrite_array_labels) | x.rlike(project.rewrite_scalar)))
    scalar_rule = _strip_quotes(v).rlike(project.rewrite_scalar)
    return (F.when(v.contains("${{"), False)
            .when(v.contains(PROVIDER_LABEL) & v.contains("self-hosted"), False)
            .when(is_array, array_rule).otherwise(scalar_rule))


def runs_on_rewrite(lines: DataFrame, text_col: str = "text", project: Project = PROJECT) -> DataFrame:
    """Lines whose ``runs-on`` value would be retargeted, with the old
    value and the new line (indent kept)."""
    t = F.col(text_col)
    val = F.regexp_extract(t, RUNS_ON_LINE, 2)
    indent = F.regexp_extract(t, RUNS_ON_LINE, 1)
    hit = lines.filter(t.rlike(RUNS_ON_LINE)).withColumn("_val", val).filter(should_rewrite(F.col("_val"), project))
    return hit.select(*[c for c in lines.columns], F.trim("_val").alias("old_value"),
                      F.concat(indent, F.lit("runs-on: " + RUNS_ON_TARGET)).alias("new_line"))


def unpinned_uses(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """``uses:`` references not pinned to a full 40-hex commit SHA.
    Comments and one pair of quotes are stripped; local (``./``), docker
    and expression references are skipped."""
    t = F.col(text_col)
    after = F.regexp_replace(F.substring_index(t, "#", 1), r"^\s*uses:", "")
    ref = F.trim(after)
    ref = F.regexp_replace(F.regexp_replace(ref, r'^"|"$', ""), r"^'|'$", "")
    skip = ref.startswith("./") | ref.startswith("docker:") | ref.startswith("${{")
    return (lines.filter(t.rlike(USES_LINE)).withColumn("ref", ref)
            .filter(~skip & ~F.col("ref").rlike(PINNED_REF)))


def forbidden_names(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """Lines naming a static cloud credential (case-insensitive)."""
    pattern = "(?i)" + "|".join(FORBIDDEN_NAMES)
    return lines.filter(F.col(text_col).rlike(pattern))


def rewrite_report(rewrites: DataFrame, repo_col: str = "repo") -> DataFrame:
    """Changed lines per repository plus the total (repo null)."""
    return rewrites.rollup(repo_col).agg(F.count(F.lit(1)).alias("changes"))
