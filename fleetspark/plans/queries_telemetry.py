"""Registered telemetry queries (S1, S2, S8, A1-A8, P20) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..schemas import STAGE_FIELDS
from ..sources.fixtures import EVENTS_AS_OF, fixture, oracle_with
from ..sources.journal import cycle_record_lines, parse_cycle_telemetry, scan_journal
from ..operators import telemetry as tm
from .sqlparts import finite_nn, nearest_rank_cte

SINCE_7D = 7 * 24 * 3600

# ---------------------------------------------------------------- S1 / S2
register("scan_journal", oracle_with(["fx_journal"], f"""
SELECT event_id, instance, line FROM fx_journal
WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{EVENTS_AS_OF}'
"""))(lambda spark, sf: scan_journal(fixture(spark, sf, "fx_journal"), EVENTS_AS_OF, SINCE_7D)
      .select("event_id", "instance", "line"))

_PARSE_SQL = """
SELECT event_id, instance, payload FROM (
  SELECT event_id, instance, substr(line, instr(line, 'cycle_telemetry ') + 16) AS payload
  FROM fx_journal WHERE instr(line, 'cycle_telemetry ') > 0) j
WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'
  AND json_extract_string(payload, '$.event') = 'runner_cycle_complete'
  AND json_type(payload, '$.schema_version') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
  AND CAST(json_extract(payload, '$.schema_version') AS DOUBLE) = 1
"""

register("parse_cycle_telemetry", oracle_with(["fx_journal"], f"""
SELECT event_id, instance, json_extract_string(payload, '$.snapshot') AS snapshot,
       json_extract_string(payload, '$.outcome') AS outcome,
       CAST(json_extract(payload, '$.total_secs') AS DOUBLE) AS total_secs
FROM ({_PARSE_SQL}) p
"""))(lambda spark, sf: parse_cycle_telemetry(fixture(spark, sf, "fx_journal"), keep=["event_id", "instance"])
      .select("event_id", "instance", "snapshot", "outcome", "total_secs"))

# ---------------------------------------------------------------- A1-A6 oracle
_STAGES = [f.removesuffix("_secs") for f in STAGE_FIELDS]


def _summary_sql(keys: list[str]) -> str:
    """Oracle for ``usage_summary`` keyed by ``keys`` + snapshot over CTE ``cyc``."""
    k = keys + ["snapshot"]
    kc = ", ".join(k)
    stage_cols = ",\n       ".join(
        f"{finite_nn(c)} AS v_{c}" if c in ("jit_mint_secs", "sandbox_create_secs", "runner_start_secs")
        else f"CAST(NULL AS DOUBLE) AS v_{c}" for c in STAGE_FIELDS)
    ctes = [f"""p AS (
  SELECT {kc},
       CASE WHEN outcome IN ('job','idle','failed','unknown') THEN outcome ELSE 'unknown' END AS outcome,
       {finite_nn('total_secs')} AS v_total,
       {stage_cols},
       cleanup_status = 'create_not_attempted' OR (cleanup_status = 'deleted' AND {finite_nn('allocated_secs')} IS NOT NULL
         AND {finite_nn('cpu')} IS NOT NULL AND {finite_nn('memory_gib')} IS NOT NULL AND {finite_nn('disk_gib')} IS NOT NULL) AS alloc_counted,
       CASE WHEN cleanup_status = 'deleted' AND {finite_nn('allocated_secs')} IS NOT NULL AND {finite_nn('cpu')} IS NOT NULL
              AND {finite_nn('memory_gib')} IS NOT NULL AND {finite_nn('disk_gib')} IS NOT NULL THEN 1 END AS full_alloc,
       cpu, memory_gib, disk_gib, allocated_secs
  FROM cyc WHERE snapshot IS NOT NULL AND snapshot <> '')"""]
    ctes.append(f"pv_total AS (SELECT {kc}, v_total AS v FROM p)")
    ctes.append(nearest_rank_cte("q_total", "pv_total", k, "p95", 0.95))
    for s, f in zip(_STAGES, STAGE_FIELDS):
        ctes.append(f"pv_{s} AS (SELECT {kc}, v_{f} AS v FROM p)")
        ctes.append(nearest_rank_cte(f"q_{s}", f"pv_{s}", k, "p95", 0.95))
    ctes.append(f"""g AS (
  SELECT {kc}, count(*) AS n,
         count(*) FILTER (WHERE outcome = 'job') AS job, count(*) FILTER (WHERE outcome = 'idle') AS idle,
         count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome = 'unknown') AS unknown,
         count(v_total) AS duration_count, sum(CAST(round(v_total * 1000000) AS HUGEINT)) AS micros,
         {', '.join(f'count(v_{f}) AS n_{s}' for s, f in zip(_STAGES, STAGE_FIELDS))},
         count(*) FILTER (WHERE alloc_counted) AS alloc_count,
         CAST(round(coalesce(sum(CASE WHEN full_alloc = 1 THEN CAST(cpu * allocated_secs AS DECIMAL(38,6)) END), 0) / 3600, 2) AS DOUBLE) AS cpu_h,
         CAST(round(coalesce(sum(CASE WHEN full_alloc = 1 THEN CAST(memory_gib * allocated_secs AS DECIMAL(38,6)) END), 0) / 3600, 2) AS DOUBLE) AS ram_h,
         CAST(round(coalesce(sum(CASE WHEN full_alloc = 1 THEN CAST(disk_gib * allocated_secs AS DECIMAL(38,6)) END), 0) / 3600, 2) AS DOUBLE) AS disk_h
  FROM p GROUP BY {kc})""")
    joins = " ".join(f"LEFT JOIN q_{s} USING ({kc})".replace("q_" + s + " USING", f"(SELECT {kc}, p95 AS p95_{s} FROM q_{s}) q_{s} USING")
                     for s in _STAGES)
    stage_sel = ", ".join(f"CASE WHEN n_{s} = n THEN round(p95_{s}, 2) END AS {s}_p95" for s in _STAGES)
    body = f"""
SELECT {', '.join('g.' + c if c in k else c for c in k)}, n, job, idle, failed, unknown, duration_count,
       CASE WHEN duration_count = n THEN ((200 * micros + 60000000 * duration_count) // (120000000 * duration_count)) / 100 END AS avg_minutes,
       CASE WHEN duration_count = n THEN round(q_total.p95 / 60, 2) END AS p95_minutes,
       {stage_sel}, alloc_count,
       CASE WHEN alloc_count = n THEN cpu_h END AS cpu_hours,
       CASE WHEN alloc_count = n THEN ram_h END AS ram_hours,
       CASE WHEN alloc_count = n THEN disk_h END AS disk_hours
FROM g LEFT JOIN q_total USING ({kc}) {joins}"""
    return ",\n".join(ctes), body


def _summary_oracle(select_cols: str, keys: list[str] | None = None) -> str:
    ctes, body = _summary_sql(keys or [])
    return oracle_with(["fx_cycles"], f"""
, cyc AS (SELECT * FROM fx_cycles),
{ctes}
SELECT {select_cols} FROM ({body}) s""")


def _cycles(spark, sf):
    return fixture(spark, sf, "fx_cycles")


register("usage_summary", _summary_oracle("*"))(lambda spark, sf: tm.usage_summary(_cycles(spark, sf)))

register("usage_by_snapshot", _summary_oracle("snapshot, n, job, idle, failed, unknown"))(
    lambda spark, sf: tm.usage_by_snapshot(_cycles(spark, sf)))

register("duration_summary", _summary_oracle(
    "snapshot, n, duration_count, avg_minutes, p95_minutes, "
    "CASE WHEN avg_minutes IS NULL THEN 'coverage=' || duration_count || '/' || n END AS coverage"))(
    lambda spark, sf: tm.duration_summary(_cycles(spark, sf)))

register("allocation_hours", _summary_oracle("snapshot, n, alloc_count, cpu_hours, ram_hours, disk_hours"))(
    lambda spark, sf: tm.allocation_hours(_cycles(spark, sf)))

register("stage_p95", _summary_oracle("snapshot, n, " + ", ".join(f"{s}_p95" for s in _STAGES)))(
    lambda spark, sf: tm.stage_p95(_cycles(spark, sf)))

register("usage_by_instance_snapshot", _summary_oracle("*", ["instance"]))(
    lambda spark, sf: tm.usage_summary(_cycles(spark, sf), ["instance"]))


def _line_sql() -> str:
    stage = " || '/' || ".join(
        f"coalesce(CASE WHEN {s}_p95 IS NOT NULL THEN '{s}=' || printf('%.2f', {s}_p95) || 's' END, '')" for s in _STAGES)
    # concat_ws skips empty parts in Spark only when they are null; the oracle
    # joins non-null parts with '/'.
    parts = ", ".join(f"CASE WHEN {s}_p95 IS NOT NULL THEN '{s}=' || printf('%.2f', {s}_p95) || 's' END" for s in _STAGES)
    del stage
    return f"""snapshot,
  printf('%s: n=%d job=%d idle=%d failed=%d unknown=%d ', snapshot, n, job, idle, failed, unknown)
  || CASE WHEN avg_minutes IS NOT NULL THEN 'avg=' || printf('%.2f', avg_minutes) || 'm p95=' || printf('%.2f', p95_minutes) || 'm'
          ELSE 'duration unavailable (coverage=' || duration_count || '/' || n || ')' END
  || CASE WHEN concat_ws('/', {parts}) <> '' THEN '; stages p95 ' || concat_ws('/', {parts}) ELSE '' END
  || '; '
  || CASE WHEN cpu_hours IS NOT NULL THEN 'allocated=' || printf('%.2f', cpu_hours) || ' CPU-h/' || printf('%.2f', ram_hours)
          || ' GiB-h RAM/' || printf('%.2f', disk_hours) || ' GiB-h disk'
          ELSE 'allocation unavailable (coverage=' || alloc_count || '/' || n || ')' END AS line"""


register("usage_report_lines", _summary_oracle(_line_sql()))(
    lambda spark, sf: tm.usage_report_lines(tm.usage_summary(_cycles(spark, sf))))

# ---------------------------------------------------------------- A7 / A8 / P20
register("legacy_spawn_class", oracle_with(["fx_journal"], """
SELECT event_id, split_part(substr(line, instr(line, '[') + 1), ']', 1) AS size_class
FROM fx_journal WHERE contains(line, 'runner up:') AND contains(line, '[')
"""))(lambda spark, sf: fixture(spark, sf, "fx_journal")
      .select("event_id", tm.legacy_spawn_class(F.col("line")).alias("size_class"))
      .filter(F.col("size_class").isNotNull()))

register("legacy_spawn_counts", oracle_with(["fx_journal"], """
SELECT instance, split_part(substr(line, instr(line, '[') + 1), ']', 1) AS size_class, count(*) AS spawns
FROM fx_journal WHERE contains(line, 'runner up:') AND contains(line, '[') GROUP BY ALL
"""))(lambda spark, sf: tm.legacy_spawn_counts(fixture(spark, sf, "fx_journal"), ["instance"]))


def _usage_report(spark, sf):
    journal = fixture(spark, sf, "fx_journal")
    parsed = parse_cycle_telemetry(journal, keep=["instance"], keep_all=True)
    return tm.usage_report(fixture(spark, sf, "fx_instances"), parsed)


def _usage_report_oracle() -> str:
    ctes, body = _summary_sql(["instance"])
    return oracle_with(["fx_journal", "fx_instances"], f"""
, parsed AS (
  SELECT instance, json_extract_string(payload, '$.snapshot') AS snapshot, json_extract_string(payload, '$.outcome') AS outcome,
         CAST(json_extract(payload, '$.total_secs') AS DOUBLE) AS total_secs,
         CAST(NULL AS DOUBLE) AS allocated_secs, json_extract_string(payload, '$.cleanup_status') AS cleanup_status,
         CAST(NULL AS DOUBLE) AS jit_mint_secs, CAST(NULL AS DOUBLE) AS sandbox_create_secs,
         CAST(NULL AS DOUBLE) AS runner_start_secs,
         CAST(NULL AS DOUBLE) AS cpu, CAST(NULL AS DOUBLE) AS memory_gib, CAST(NULL AS DOUBLE) AS disk_gib
  FROM ({_PARSE_SQL}) x),
cyc AS (SELECT * FROM parsed),
{ctes},
lines AS (SELECT instance, {_line_sql()} FROM ({body}) s),
inst AS (SELECT DISTINCT instance FROM fx_instances WHERE coalesce(unit, '') <> ''),
stats AS (SELECT instance, count(*) FILTER (WHERE contains(line, 'runner up:') AND contains(line, '[')) AS runner_up
          FROM fx_journal GROUP BY instance),
pn AS (SELECT instance, count(*) AS completions FROM parsed GROUP BY instance),
leg AS (SELECT instance, string_agg(spawns || ' ' || size_class, ', ' ORDER BY size_class) AS legacy FROM (
          SELECT instance, split_part(substr(line, instr(line, '[') + 1), ']', 1) AS size_class, count(*) AS spawns
          FROM fx_journal WHERE contains(line, 'runner up:') AND contains(line, '[') GROUP BY ALL) c GROUP BY instance),
structured AS (SELECT DISTINCT instance AS instance_s FROM lines)
SELECT i.instance, 0 AS line_no,
       CASE WHEN s.instance_s IS NOT NULL THEN
            i.instance || ': structured completions=' || coalesce(completions, 0) || '; runner-up lines='
            || coalesce(runner_up, 0) || '; window may span the telemetry rollout'
            ELSE i.instance || ': legacy window; ' || coalesce(nullif(legacy, ''), 'no spawns') END AS text
FROM inst i LEFT JOIN structured s ON s.instance_s = i.instance LEFT JOIN stats USING (instance)
     LEFT JOIN pn USING (instance) LEFT JOIN leg USING (instance)
UNION ALL
SELECT l.instance, row_number() OVER (PARTITION BY l.instance ORDER BY snapshot) AS line_no, '  ' || line AS text
FROM lines l SEMI JOIN inst ON inst.instance = l.instance
""")


register("usage_report", _usage_report_oracle())(_usage_report)


# ---------------------------------------------------------------- S8 round trip
def _roundtrip(spark, sf):
    cyc = _cycles(spark, sf)
    rec = cyc.select(
        F.lit("runner_cycle_complete").alias("event"), F.lit(1).alias("schema_version"),
        F.col("cycle_id").cast("string").alias("cycle_id"), "snapshot", "size_class", "repository", "outcome",
        "cleanup_status", "total_secs", "allocated_secs", "jit_mint_secs", "sandbox_create_secs", "runner_start_secs",
        F.struct("cpu", "memory_gib", "disk_gib").alias("declared_resources"))
    back = parse_cycle_telemetry(cycle_record_lines(rec), keep=[])
    return back.select(F.col("cycle_id").cast("long").alias("cycle_id"), "snapshot", "size_class", "repository",
                       "outcome", "cleanup_status", "total_secs", "allocated_secs", "sandbox_create_secs",
                       F.col("declared_resources.cpu").alias("cpu"))


register("cycle_record_roundtrip", oracle_with(["fx_cycles"], """
SELECT cycle_id, snapshot, size_class, repository, outcome, cleanup_status, total_secs, allocated_secs,
       sandbox_create_secs, cpu FROM fx_cycles
"""))(_roundtrip)


def _ranks(spark, sf):
    c = _cycles(spark, sf).select("instance", F.col("total_secs").alias("v"))
    out = None
    for p in (0.5, 0.9, 0.95, 0.99):
        r = tm.nearest_rank_table(c, ["instance"], ["v"], p, suffix="").withColumnRenamed("v", f"p{int(p * 100)}")
        out = r if out is None else out.join(r, "instance")
    return out


register("nearest_rank", oracle_with(["fx_cycles"], f"""
, pv AS (SELECT instance, total_secs AS v FROM fx_cycles),
{nearest_rank_cte("r50", "pv", ["instance"], "p50", 0.5)},
{nearest_rank_cte("r90", "pv", ["instance"], "p90", 0.9)},
{nearest_rank_cte("r95", "pv", ["instance"], "p95", 0.95)},
{nearest_rank_cte("r99", "pv", ["instance"], "p99", 0.99)}
SELECT * FROM r50 JOIN r90 USING (instance) JOIN r95 USING (instance) JOIN r99 USING (instance)
"""))(_ranks)
