"""Registered workflow text queries (P20 is with telemetry; P21-P23, A24)."""

from __future__ import annotations

from ..catalog import register
from ..fixed import PROJECT, PROVIDER_LABEL, RUNS_ON_TARGET
from ..operators import textscan as ts
from ..sources.fixtures import fixture, oracle_with


def lines_df(spark, sf):
    return fixture(spark, sf, "fx_workflow_lines").unionByName(fixture(spark, sf, "fx_workflow_extra"))


_L = "wl AS (SELECT * FROM fx_workflow_lines UNION ALL SELECT * FROM fx_workflow_extra)"
_VIEWS = ["fx_workflow_lines", "fx_workflow_extra"]
_ARR = ", ".join(f"'{x}'" for x in PROJECT.rewrite_array_labels)
_SCALAR = PROJECT.rewrite_scalar.removeprefix("^").removesuffix("$")
_SQ = "regexp_replace({x}, '^[''\"]+|[''\"]+$', '', 'g')"
_RW = f"""
m AS (SELECT *, trim(regexp_extract(text, '^(\\s*)runs-on:\\s*(.+?)\\s*$', 2)) AS v,
             regexp_extract(text, '^(\\s*)runs-on:\\s*(.+?)\\s*$', 1) AS indent
      FROM wl WHERE regexp_matches(text, '^(\\s*)runs-on:\\s*(.+?)\\s*$')),
r AS (SELECT *, list_transform(string_split(substring(v, 2, length(v) - 2), ','), lambda x: {_SQ.format(x='trim(x)')}) AS parts
      FROM m),
rw AS (SELECT repo, line_no, text, v AS old_value, indent || 'runs-on: {RUNS_ON_TARGET}' AS new_line FROM r
       WHERE CASE WHEN contains(v, '${{{{') THEN false
                  WHEN contains(v, '{PROVIDER_LABEL}') AND contains(v, 'self-hosted') THEN false
                  WHEN starts_with(v, '[') AND ends_with(v, ']') THEN
                       NOT list_bool_or(list_transform(parts, lambda x: x IN ('windows', 'macos', 'macOS')))
                       AND list_bool_or(list_transform(parts, lambda x: x IN ({_ARR})
                           OR regexp_full_match(x, '{_SCALAR}')))
                  ELSE regexp_full_match({_SQ.format(x='v')}, '{_SCALAR}') END)
"""

register("runs_on_rewrite", oracle_with(_VIEWS, f", {_L}, {_RW} SELECT * FROM rw"))(
    lambda spark, sf: ts.runs_on_rewrite(lines_df(spark, sf)))

register("rewrite_report", oracle_with(_VIEWS, f", {_L}, {_RW} SELECT repo, count(*) AS changes FROM rw GROUP BY ROLLUP (repo)"))(
    lambda spark, sf: ts.rewrite_report(ts.runs_on_rewrite(lines_df(spark, sf))))

register("unpinned_uses", oracle_with(_VIEWS, f"""
, {_L},
u AS (SELECT *, trim(regexp_replace(split_part(text, '#', 1), '^\\s*uses:', '')) AS r0 FROM wl
      WHERE regexp_matches(text, '^\\s*uses:\\s*[^#\\s]+')),
q AS (SELECT repo, line_no, text, regexp_replace(regexp_replace(r0, '^"|"$', '', 'g'), '^''|''$', '', 'g') AS ref FROM u)
SELECT * FROM q WHERE NOT (starts_with(ref, './') OR starts_with(ref, 'docker:') OR starts_with(ref, '${{{{'))
  AND NOT regexp_matches(ref, '@[0-9a-fA-F]{{40}}$')
"""))(lambda spark, sf: ts.unpinned_uses(lines_df(spark, sf)))

register("forbidden_names", oracle_with(_VIEWS, f"""
, {_L} SELECT * FROM wl WHERE regexp_matches(text, '{"|".join(ts.FORBIDDEN_NAMES)}', 'i')
"""))(lambda spark, sf: ts.forbidden_names(lines_df(spark, sf)))
