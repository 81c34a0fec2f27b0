"""Fixture views over the driver tables.

Each view is portable SQL that runs unchanged on Spark 4.1 and DuckDB, so
the Spark operators and the DuckDB oracle read byte-identical inputs.  On
Spark the view is bound to lazily-read Parquet DataFrames through
``spark.sql(text, **frames)``; Catalyst still prunes columns and pushes
filters into each scan.  Label lists are comma text; operators split them.
``as_of`` constants are fixed, never the clock.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..fixed import PROJECT, PROVIDER_LABEL
from .tables import table

# Fixed as-of instants (TIMESTAMP_NTZ): end of the events month, and a day
# after the last order date.
EVENTS_AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "1999-01-01 00:00:00"

VIEWS: dict[str, str] = {}

VIEWS["fx_cycles"] = """
SELECT event_id AS cycle_id,
       'inst-' || CAST(user_id % 4 AS STRING) AS instance,
       CASE WHEN event_id % 97 = 0 THEN NULL ELSE 'snap-' || event_type END AS snapshot,
       CASE WHEN user_id % 3 = 0 THEN 'large' ELSE 'default' END AS size_class,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'repo-' || CAST(user_id % 11 AS STRING) END AS repository,
       CASE WHEN event_id % 6 <= 1 THEN 'job' WHEN event_id % 6 = 2 THEN 'idle'
            WHEN event_id % 6 = 3 THEN 'failed' WHEN event_id % 6 = 4 THEN 'unknown' ELSE 'other' END AS outcome,
       CASE WHEN event_id % 31 = 0 THEN 'create_not_attempted'
            WHEN event_type = 'error' AND event_id % 29 = 0 THEN 'delete_failed' ELSE 'deleted' END AS cleanup_status,
       CASE WHEN event_type = 'view' AND event_id % 50 = 0 THEN NULL ELSE value END AS total_secs,
       CASE WHEN event_id % 31 = 0 OR (event_type = 'error' AND event_id % 29 = 0) THEN NULL ELSE value END AS allocated_secs,
       CAST(event_id % 7 AS DOUBLE) AS jit_mint_secs,
       CASE WHEN event_type = 'click' AND event_id % 40 = 0 THEN NULL ELSE CAST(event_id % 13 AS DOUBLE) END AS sandbox_create_secs,
       CAST(event_id % 5 AS DOUBLE) AS runner_start_secs,
       CAST(CASE WHEN user_id % 3 = 0 THEN 4 ELSE 2 END AS DOUBLE) AS cpu,
       CAST(CASE WHEN user_id % 3 = 0 THEN 8 ELSE 4 END AS DOUBLE) AS memory_gib,
       CAST(10 AS DOUBLE) AS disk_gib,
       ts AS completed_at
FROM events
"""

VIEWS["fx_journal"] = """
SELECT event_id, ts, 'inst-' || CAST(user_id % 4 AS STRING) AS instance,
       CASE WHEN event_id % 11 = 0 THEN '[' || event_type || '] runner up: sandbox=' || CAST(event_id AS STRING)
            WHEN event_id % 13 = 0 THEN 'INFO cycle_telemetry not-json'
            WHEN event_id % 17 = 0 THEN 'unrelated message'
            ELSE 'INFO cycle_telemetry {"event":"runner_cycle_complete","schema_version":'
                 || CASE WHEN event_id % 19 = 0 THEN '2' ELSE '1' END
                 || ',"snapshot":"snap-' || event_type || '","outcome":"job","total_secs":'
                 || CAST(event_id % 600 AS STRING) || '}' END AS line
FROM events
"""

# Watchdog instance list: one row per instance seen in the journal, plus
# its systemd unit name (an instance without a unit is skipped).
VIEWS["fx_instances"] = """
SELECT DISTINCT 'inst-' || CAST(user_id % 4 AS STRING) AS instance,
       CASE WHEN user_id % 4 = 3 THEN '' ELSE 'runner-' || CAST(user_id % 4 AS STRING) || '.service' END AS unit
FROM events
"""

VIEWS["fx_jobs"] = """
SELECT o_orderkey AS job_id, o_orderkey % 1000 AS run_id,
       'repo-' || CAST(o_custkey % 25 AS STRING) AS repository,
       CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'in_progress' ELSE 'completed' END AS status,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'self-hosted,pool,ci,large' WHEN '2-HIGH' THEN 'self-hosted,pool,ci'
            WHEN '3-MEDIUM' THEN 'self-hosted,pool' WHEN '4-NOT SPECIFIED' THEN 'ubuntu-latest'
            ELSE 'self-hosted,pool,ci,large,extra' END AS labels,
       o_orderdate AS created_at
FROM orders
"""

# Workflow-run listings: a run can be listed under more than one status
# (the queued and in-progress listings are taken moments apart).
VIEWS["fx_runs"] = """
SELECT DISTINCT 'repo-' || CAST(o_custkey % 25 AS STRING) AS repository, o_orderkey % 1000 AS run_id,
       CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'in_progress' ELSE 'completed' END AS status
FROM orders
"""

# Repositories configured for a repository-scoped fleet, in config order.
VIEWS["fx_configured_repos"] = """
SELECT DISTINCT 'repo-' || CAST(c_custkey % 25 AS STRING) AS repository, c_custkey % 25 AS repo_pos
FROM customer
"""

VIEWS["fx_size_classes"] = """
SELECT * FROM (VALUES (0, 'default', 'self-hosted,pool,ci', 3, 40),
                      (1, 'large', 'self-hosted,pool,ci,large', 0, 25),
                      (2, 'large-b', 'self-hosted,pool,ci,xl', 0, 5)) AS t(class_pos, name, labels, min_idle, max_live)
"""

# The same classes with caps sized for a fleet the registry fixture can fill
# (warm floor on ``default``), so the spawn plan has work at every scale.
VIEWS["fx_size_classes_fleet"] = """
SELECT * FROM (VALUES (0, 'default', 'self-hosted,pool,ci', 1500, 4000),
                      (1, 'large', 'self-hosted,pool,ci,large', 0, 2500),
                      (2, 'large-b', 'self-hosted,pool,ci,xl', 0, 500)) AS t(class_pos, name, labels, min_idle, max_live)
"""

VIEWS["fx_registry"] = """
SELECT event_id AS cycle_id, CASE WHEN user_id % 3 = 0 THEN 'large' ELSE 'default' END AS cls_name,
       CASE WHEN event_id % 5 = 0 THEN 'SPAWNING' WHEN event_id % 5 = 1 THEN 'BUSY'
            WHEN event_id % 5 = 2 THEN 'CLEANUP_PENDING' ELSE 'IDLE' END AS state,
       CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'repo-' || CAST(user_id % 25 AS STRING) END AS repository,
       CASE WHEN event_id % 20 < 7 THEN event_id ELSE event_id + 1000000000 END AS runner_id,
       CASE WHEN event_id % 20 < 7 THEN event_id * 3 ELSE event_id * 3 + 1000000000 END AS sandbox_no, ts AS spawned_at
FROM events
"""

VIEWS["fx_runners"] = """
SELECT event_id AS runner_id,
       CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'repo-' || CAST(user_id % 25 AS STRING) END AS repository,
       CASE WHEN event_id % 3 = 0 THEN 'offline' ELSE 'online' END AS status,
       CASE WHEN event_id % 10 = 0 THEN 'other-' ELSE '""" + PROJECT.runner_name_prefix + """' END || CAST(event_id AS STRING) AS name,
       CASE WHEN event_id % 4 = 0 THEN '""" + PROVIDER_LABEL + """'
            ELSE '""" + PROVIDER_LABEL + "," + PROJECT.fleet_label_prefix + """f' || CAST(user_id % 3 AS STRING) END AS labels,
       event_id % 6 = 1 AS busy
FROM events
"""

VIEWS["fx_sandboxes"] = """
SELECT o_orderkey AS sandbox_no, CASE WHEN o_orderkey % 9 = 0 THEN 'other' ELSE 'gha-runner' END AS role,
       'org-' || CAST(o_custkey % 3 AS STRING) AS org,
       CASE WHEN o_orderkey % 4 = 0 THEN 'repository' ELSE NULL END AS scope,
       CASE WHEN o_orderkey % 4 = 0 THEN 'f' || CAST(o_custkey % 3 AS STRING) ELSE NULL END AS fleet,
       CASE WHEN o_orderkey % 21 = 0 THEN NULL ELSE o_orderdate END AS created_at
FROM orders
"""

# Provider view of the same sandboxes: id text, ISO creation text (some
# without an offset, which the age rule treats as unknown).
VIEWS["fx_sandbox_inventory"] = """
SELECT 'sbx-' || CAST(o_orderkey AS STRING) AS sandbox_id, o_orderkey AS sandbox_no,
       CASE WHEN o_orderkey % 9 = 0 THEN 'other' ELSE 'gha-runner' END AS role,
       'org-' || CAST(o_custkey % 3 AS STRING) AS org,
       CASE WHEN o_orderkey % 4 = 0 THEN 'repository' ELSE NULL END AS scope,
       CASE WHEN o_orderkey % 4 = 0 THEN 'f' || CAST(o_custkey % 3 AS STRING) ELSE NULL END AS fleet,
       CASE WHEN o_orderkey % 21 = 0 THEN NULL
            WHEN o_orderkey % 10 = 3 THEN replace(CAST(o_orderdate AS STRING), ' ', 'T')
            WHEN o_orderkey % 10 = 7 THEN replace(CAST(o_orderdate AS STRING), ' ', 'T') || '+02:00'
            WHEN o_orderkey % 50 = 1 THEN 'not-a-date'
            ELSE replace(CAST(o_orderdate AS STRING), ' ', 'T') || 'Z' END AS created_at
FROM orders
"""

VIEWS["fx_repos"] = """
SELECT 'Repo-' || CAST(c_custkey AS STRING) AS name, c_custkey % 3 <> 0 AS private,
       CASE WHEN c_nationkey % 2 = 0 THEN 'Acme' ELSE 'acme' END AS owner_login
FROM customer
"""

VIEWS["fx_group_repos"] = """
SELECT CASE WHEN c_custkey % 4 = 0 THEN 'elsewhere-' ELSE 'repo-' END || CAST(c_custkey + 7 AS STRING) AS name FROM customer
"""

# Runner groups visible to each configured repository.
VIEWS["fx_repo_groups"] = """
SELECT DISTINCT 'repo-' || CAST(c_custkey % 25 AS STRING) AS repository, c_nationkey % 4 + 1 AS group_id,
       CASE WHEN c_nationkey % 4 = 0 THEN 'ci-runners'
            WHEN c_nationkey = 7 AND c_custkey % 25 < 5 THEN 'ci-runners'
            ELSE 'group-' || CAST(c_nationkey % 4 AS STRING) END AS group_name
FROM customer
"""

# Watchdog instances: units up, down and unset, installations of either selection.
VIEWS["fx_instances"] = """
SELECT 'inst-' || CAST(s_suppkey AS STRING) AS instance, CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL
         ELSE 'runner-' || CAST(s_suppkey AS STRING) || '.service' END AS unit,
       CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE s_suppkey % 3 <> 0 END AS active,
       CASE WHEN s_suppkey % 5 = 0 THEN 'repository' ELSE 'organization' END AS scope,
       CASE WHEN s_suppkey % 7 = 0 THEN 'selected' WHEN s_suppkey % 13 = 0 THEN NULL ELSE 'all' END AS repository_selection
FROM supplier
"""

# Organization runner groups (one per supplier, so the table grows with
# the data): repeated names, missing ids, public or non-selected groups.
VIEWS["fx_runner_groups"] = """
SELECT CASE WHEN s_suppkey % 6 = 5 THEN NULL ELSE s_suppkey END AS id,
       CASE WHEN s_suppkey % 5 = 0 THEN 'ci-runners' ELSE 'group-' || CAST(s_suppkey % 97 AS STRING) END AS name,
       CASE WHEN s_nationkey % 2 = 0 THEN 'selected' ELSE 'all' END AS visibility,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 3 = 0 END AS allows_public_repositories
FROM supplier
"""

VIEWS["fx_snapshots"] = """
SELECT 'snapshot-' || CAST(p_partkey AS STRING) AS snapshot_id,
       CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE p_name || ' ' || CAST(p_partkey % 50 AS STRING) END AS name,
       CASE WHEN p_size % 5 = 0 THEN 'inactive' ELSE 'Active' END AS state,
       CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS size,
       p_brand AS image_name, CAST(2 AS DOUBLE) AS cpu, CAST(4 AS DOUBLE) AS memory_gib, CAST(10 AS DOUBLE) AS disk_gib,
       CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE CAST(0 AS DOUBLE) END AS gpu,
       'container' AS sandbox_class, CASE WHEN p_type = 'PROMO' THEN 'us,eu' ELSE 'us' END AS region_ids
FROM part
"""

# Raw provider JSON for the same parts: alternate key spellings, nested
# resources / buildInfo, wrong types, a present-but-null createdAt, junk
# regions and a few repeated ids.
VIEWS["fx_snapshot_json"] = """
SELECT p_partkey AS pos, CAST(floor(p_partkey / 200) AS BIGINT) + 1 AS page,
  '{"id":"snapshot-' || CAST(CASE WHEN p_partkey % 53 = 0 THEN p_partkey - 1 ELSE p_partkey END AS STRING) || '"'
  || CASE WHEN p_partkey % 41 = 0 THEN '' ELSE ',"name":"' || p_name || ' ' || CAST(p_partkey % 50 AS STRING) || '"' END
  || ',"state":"' || CASE WHEN p_size % 5 = 0 THEN 'inactive' ELSE 'Active' END || '"'
  || CASE WHEN p_partkey % 23 = 0 THEN ',"size":null' WHEN p_partkey % 29 = 0 THEN ',"size":"12"'
          ELSE ',"size":' || CAST(p_size AS STRING) END
  || CASE WHEN p_partkey % 3 = 0 THEN ',"createdAt":"2024-01-01T00:00:00Z"'
          WHEN p_partkey % 3 = 1 THEN ',"created_at":"2024-02-01T00:00:00Z"'
          ELSE ',"createdAt":null,"created_at":"2024-03-01T00:00:00Z"' END
  || CASE WHEN p_partkey % 4 = 0 THEN ',"imageName":"' || p_brand || '"'
          WHEN p_partkey % 4 = 1 THEN ',"image_name":"' || p_brand || '"'
          WHEN p_partkey % 4 = 2 THEN ',"image":"' || p_brand || '"' ELSE ',"imageName":""' END
  || CASE WHEN p_partkey % 43 = 0 THEN ',"cpu":-2,"mem":4,"disk":10,"gpu":0'
          WHEN p_partkey % 37 = 0 THEN ',"cpu":2,"mem":4,"disk":10,"gpu":true'
          WHEN p_partkey % 2 = 0 THEN ',"cpu":2,"mem":4.0,"disk":10,"gpu":0'
          ELSE ',"resources":{"cpu":2,"memory":4,"disk":10.5,"gpu":0}' END
  || CASE WHEN p_partkey % 5 = 0 THEN ',"buildInfo":{"snapshotRef":"ref-' || CAST(p_partkey AS STRING) || '"}'
          WHEN p_partkey % 5 = 1 THEN ',"ref":"r-' || CAST(p_partkey AS STRING) || '"'
          WHEN p_partkey % 5 = 2 THEN ',"build_info":{"snapshot_ref":"sr-' || CAST(p_partkey AS STRING) || '"}' ELSE '' END
  || CASE WHEN p_partkey % 2 = 0 THEN ',"sandboxClass":"container"' ELSE ',"sandbox_class":"container"' END
  || CASE WHEN p_type = 'PROMO' THEN ',"regionIds":["us","eu",""]'
          WHEN p_type = 'SMALL' THEN ',"region_ids":["us",5]'
          WHEN p_partkey % 47 = 0 THEN ',"regionIds":"us"' ELSE ',"regionIds":["us"]' END
  || '}' AS raw
FROM part
"""

# Captured inventory page headers, in capture order (position), with one
# page reporting a different total.
VIEWS["fx_inventory_pages"] = """
SELECT DISTINCT CAST(floor(p_partkey / 200) AS BIGINT) + 1 AS position,
       CAST(floor(p_partkey / 200) AS BIGINT) + 1 AS page,
       CASE WHEN CAST(floor(p_partkey / 200) AS BIGINT) = 3 THEN 1001
            ELSE CAST(floor((count(*) OVER () - 1) / 200) AS BIGINT) + 1 END AS total_pages
FROM part
"""

VIEWS["fx_profile_refs"] = """
SELECT CASE WHEN p_partkey % 3 <> 0 THEN 'retired-' || CAST(p_partkey % 100 AS STRING)
            WHEN p_partkey % 6 = 0 THEN 'missing-' || CAST(p_partkey AS STRING)
            ELSE p_name || ' ' || CAST(p_partkey % 50 AS STRING) END AS snapshot,
       'fleet-' || CAST(p_partkey % 5 AS STRING) AS fleet,
       CASE WHEN p_partkey % 2 = 0 THEN 'default' ELSE 'large' END AS size_class
FROM part
"""

VIEWS["fx_api_log"] = """
SELECT event_id, ts, 'f' || CAST(user_id % 3 AS STRING) AS fleet,
       CASE WHEN event_type = 'error' THEN 403 WHEN event_type = 'signup' THEN 429 ELSE 200 END AS status,
       CASE WHEN event_id % 8 = 0 THEN CAST(event_id % 30 AS STRING) ELSE NULL END AS retry_after,
       CASE WHEN event_id % 12 = 0 THEN '0' ELSE '4876' END AS remaining,
       event_type = 'purchase' AS tick_completed
FROM events
"""

# Epoch marks of finished cycles plus the facts that ended each cycle.
VIEWS["fx_cycle_marks"] = """
SELECT event_id AS cycle_id, 'snap-' || event_type AS snapshot,
  CAST(1700000000 + event_id * 10 AS DOUBLE) AS spawned_at,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST(1700000000 + event_id * 10 AS DOUBLE) + 0.125 END AS jit_started_at,
  CASE WHEN event_id % 23 = 0 OR event_id % 47 = 0 THEN NULL
       ELSE CAST(1700000000 + event_id * 10 AS DOUBLE) + 0.125 + (event_id % 5) * 0.25 END AS jit_completed_at,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST(1700000000 + event_id * 10 AS DOUBLE) + 2.5 END AS sandbox_started_at,
  CASE WHEN event_id % 29 = 0 OR event_id % 31 = 0 THEN NULL WHEN event_id % 53 = 0 THEN CAST(1700000000 + event_id * 10 AS DOUBLE) + 7.0
       ELSE CAST(1700000000 + event_id * 10 AS DOUBLE) + 2.5 + (event_id % 7) * 0.375 END AS sandbox_ready_at,
  CASE WHEN event_id % 29 = 0 OR event_id % 31 = 0 OR event_id % 37 = 0 THEN NULL
       ELSE CAST(1700000000 + event_id * 10 AS DOUBLE) + 6.0 END AS runner_command_started_at,
  CASE WHEN event_id % 4 = 1 THEN CAST(1700000000 + event_id * 10 AS DOUBLE) + 6.0 + (event_id % 11) END AS busy_at,
  CAST(1700000000 + event_id * 10 AS DOUBLE) + 7.0 + (event_id % 11) + (event_id % 13) * 2.125 AS completed_at,
  CASE WHEN event_id % 29 = 0 OR event_id % 43 = 0 THEN NULL
       ELSE CAST(1700000000 + event_id * 10 AS DOUBLE) + 8.5 + (event_id % 11) + (event_id % 13) * 2.125 END AS allocation_completed_at,
  CASE WHEN event_id % 17 = 0 THEN 'exception' WHEN event_id % 6 = 0 THEN 'runner_exit'
       WHEN event_id % 6 = 1 THEN 'session_unreadable' WHEN event_id % 6 = 2 THEN 'job_max'
       WHEN event_id % 6 = 3 THEN 'drain' WHEN event_id % 6 = 4 THEN 'quiesce' ELSE 'idle_deadline' END AS ended_by,
  CASE WHEN event_id % 6 = 0 THEN CAST(event_id % 3 AS INT) END AS exit_code,
  event_id % 29 <> 0 OR event_id % 58 = 0 AS create_attempted,
  event_id % 29 <> 0 AS sandbox_created,
  event_id % 43 = 0 AS delete_failed,
  event_id % 59 <> 0 AS jit_attempted,
  event_id % 61 <> 0 AS runner_registered,
  CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 5 = 1 THEN '' ELSE 'fleet-' || CAST(user_id % 3 AS STRING) END AS label_fleet,
  CASE WHEN user_id % 7 = 0 THEN NULL ELSE 'org-' || CAST(user_id % 2 AS STRING) END AS label_org
FROM events
"""

# Lifecycle events per cycle (one cycle per user), in time order.
VIEWS["fx_cycle_events"] = """
SELECT user_id AS cycle_id, event_id, ts,
       CASE event_type WHEN 'signup' THEN 'spawned' WHEN 'view' THEN 'online' WHEN 'click' THEN 'busy'
                       WHEN 'purchase' THEN 'completed' ELSE 'deleted' END AS event
FROM events
"""

# Lifecycle events of many short-lived cycles: four events each (ids follow
# time), the spawn, the online mark, then what the last two types say; a
# deletion comes last.
VIEWS["fx_timer_events"] = """
SELECT CAST(floor(event_id / 4.0) AS BIGINT) AS cycle_id, event_id, ts,
       CASE event_id % 4 WHEN 0 THEN 'spawned' WHEN 1 THEN 'online'
            WHEN 2 THEN CASE WHEN event_type IN ('click', 'view') THEN 'busy' WHEN event_type = 'purchase' THEN 'completed' ELSE 'online' END
            ELSE CASE WHEN event_type = 'signup' THEN 'deleted' WHEN event_type = 'purchase' THEN 'completed'
                      WHEN event_type = 'click' THEN 'busy' ELSE 'online' END END AS event
FROM events
"""

# Watchdog passes of five days: errors and purchases are findings, and every event tells its pass's end.
VIEWS["fx_alert_passes"] = """
SELECT CAST(floor((day(ts) - 1) / 5.0) AS BIGINT) + 1 AS pass_id,
       CAST(1704067200 + 432000 * (CAST(floor((day(ts) - 1) / 5.0) AS BIGINT) + 1) AS DOUBLE) AS now_epoch,
       event_type || '|' || CAST(user_id AS STRING) AS key, 'finding ' || event_type || ' of ' || CAST(user_id AS STRING) AS text
FROM events WHERE event_type IN ('error', 'purchase')
UNION ALL
SELECT CAST(floor((day(ts) - 1) / 5.0) AS BIGINT) + 1, CAST(1704067200 + 432000 * (CAST(floor((day(ts) - 1) / 5.0) AS BIGINT) + 1) AS DOUBLE),
       CAST(NULL AS STRING), CAST(NULL AS STRING)
FROM events
"""

# Policies with nested bodies, the desired ones in another order; some names, types and values differ.
VIEWS["fx_policies_actual"] = """
SELECT 'policy-' || CAST(s_suppkey AS STRING) AS name, CASE WHEN s_suppkey % 9 = 0 THEN 'tag' ELSE 'branch' END AS type,
       '{"rules": [{"type": "checks", "with": {"strict": true, "names": ["lint", "test"], "n": ' || CAST(s_nationkey AS STRING)
       || '}}, {"type": "deletion"}], "on": []}' AS body
FROM supplier
"""
VIEWS["fx_policies_desired"] = """
SELECT 'policy-' || CAST(CASE WHEN s_suppkey % 11 = 0 THEN -s_suppkey ELSE s_suppkey END AS STRING) AS name,
       CASE WHEN s_suppkey % 6 = 0 THEN 'tag' ELSE 'branch' END AS type,
       '{"on": [], "rules": [{"type": "deletion"}, {"with": {"n": ' || CAST(s_nationkey + CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END AS STRING)
       || ', "names": ["test", "lint"], "strict": true}, "type": "checks"}]}' AS body
FROM supplier
"""

# Session polls per cycle: an unreadable session with the runner confirmed
# idle advances the failure streak; anything else resets it.
VIEWS["fx_polls"] = """
SELECT user_id % 97 AS cycle_id, event_id, ts,
       CASE WHEN event_type IN ('error', 'view') THEN 'unreadable_idle'
            WHEN event_type = 'click' THEN 'unreadable_busy' ELSE 'ok' END AS result
FROM events
"""

# API responses with rate-limit headers (Retry-After as seconds or HTTP
# date; X-RateLimit-Reset as epoch seconds).
VIEWS["fx_api_responses"] = """
SELECT event_id, ts, 'f' || CAST(user_id % 3 AS STRING) AS fleet,
       CASE WHEN event_type = 'error' THEN 403 WHEN event_type = 'signup' THEN 429 ELSE 200 END AS status,
       CASE WHEN event_id % 40 = 0 THEN 'Wed, 31 Jan 2024 00:00:00 GMT'
            WHEN event_id % 8 = 0 THEN ' ' || CAST(event_id % 30 AS STRING) || ' '
            WHEN event_id % 9 = 0 THEN 'soon' ELSE NULL END AS retry_after,
       CASE WHEN event_id % 24 = 0 THEN '1706659200' WHEN event_id % 12 = 0 THEN '1704067200' ELSE NULL END AS reset,
       CASE WHEN event_id % 12 = 0 THEN '0' ELSE '4876' END AS remaining
FROM events
"""

VIEWS["fx_deliveries"] = """
SELECT event_id, ts, CASE WHEN event_id % 14 = 0 THEN 'ping' WHEN event_id % 15 = 0 THEN 'push' ELSE 'workflow_job' END AS event,
       CASE WHEN event_type = 'click' THEN 'queued' ELSE 'completed' END AS action,
       CASE WHEN user_id % 3 = 0 THEN 'self-hosted,pool,ci,extra' WHEN user_id % 3 = 1 THEN 'self-hosted' ELSE '' END AS labels
FROM events
"""

# Webhook HTTP requests built from the deliveries: path, Content-Length,
# event header and the JSON body (some malformed).  The sender's signature
# is added by the query (HMAC needs the secret).
VIEWS["fx_webhook_requests"] = """
SELECT event_id, ts,
       CASE WHEN event_id % 41 = 0 THEN '/other' WHEN event_id % 3 = 0 THEN '/webhook' ELSE '/github' END AS path,
       CASE WHEN event_id % 45 = 0 THEN 'abc' WHEN event_id % 46 = 0 THEN '2000000' WHEN event_id % 47 = 0 THEN '-1'
            ELSE CAST(length(body) AS STRING) END AS content_length,
       event, body
FROM (
  SELECT event_id, ts, CASE WHEN event_id % 14 = 0 THEN 'ping' WHEN event_id % 15 = 0 THEN 'push' ELSE 'workflow_job' END AS event,
         CASE WHEN event_id % 33 = 0 THEN 'not json' WHEN event_id % 35 = 0 THEN '[1,2]'
              WHEN event_id % 37 = 0 THEN '{"action":"queued","workflow_job":"x"}'
              ELSE '{"action":"' || CASE WHEN event_type = 'click' THEN 'queued' ELSE 'completed' END
                   || '","workflow_job":{"labels":['
                   || CASE WHEN user_id % 3 = 0 THEN '"self-hosted","pool","ci","extra"' WHEN user_id % 3 = 1 THEN '"self-hosted"'
                           WHEN user_id % 9 = 2 THEN '"self-hosted","pool","ci",7,""' ELSE '' END
                   || ']}}' END AS body
  FROM events) d
"""

# Every line of every text as it is, and a workflow shape beside half of them
# as a further row, numbered below zero.  The engines split a text
# differently, so only that part has two spellings.
_LINES = """
SELECT 'repo-' || source AS repo, CASE WHEN shape THEN -1 - k ELSE k END AS line_no,
       CASE WHEN NOT shape THEN line ELSE
       CASE k0 %% 14 WHEN 0 THEN '    runs-on: ubuntu-latest' WHEN 1 THEN '  runs-on: [self-hosted, old]'
            WHEN 2 THEN 'runs-on: ${{ matrix.os }}' WHEN 3 THEN '      uses: actions/checkout@v4 # ' || line
            WHEN 4 THEN '      uses: ./local' WHEN 5 THEN 'runs-on: [self-hosted, windows]'
            ELSE 'name: ' || line END END AS text
FROM (SELECT source, line, doc_id * 1000000 + i AS k, doc_id + i AS k0, false AS shape FROM (%(split)s) a
      UNION ALL
      SELECT source, line, doc_id * 1000000 + i AS k, doc_id + i AS k0, true AS shape FROM (%(split)s) b
      WHERE (doc_id + i) %% 14 < 7) l
"""
VIEWS["fx_workflow_lines"] = _LINES % {"split": """
SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
       generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
"""}
SPARK_VIEWS = {"fx_workflow_lines": _LINES % {"split": """
SELECT doc_id, source, line, i0 + 1 AS i FROM documents LATERAL VIEW posexplode(split(text, '\\n')) AS i0, line
"""}}

_TABLE_RE = re.compile(r"\b(?:FROM|JOIN)\s+([a-z_]+)\b", re.IGNORECASE)


def view_tables(name: str) -> list[str]:
    """Driver tables a fixture view reads."""
    return sorted({t for t in _TABLE_RE.findall(VIEWS[name]) if not t.startswith("fx_")})


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Bind a fixture view to the driver tables under ``sf_dir``."""
    # Escape literal braces (workflow text holds ``${{ … }}``) before the
    # table names become ``{placeholders}`` for ``spark.sql``.
    text = SPARK_VIEWS.get(name, VIEWS[name]).replace("{", "{{").replace("}", "}}")
    frames = {t: table(spark, sf_dir, t) for t in view_tables(name)}
    for t in frames:
        text = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **frames)


def oracle_with(names: list[str] | tuple[str, ...], body: str) -> str:
    """DuckDB oracle text: the named fixture views as CTEs, then ``body``."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    return f"WITH {ctes}\n{body.strip()}"


# More workflow line shapes (quoted refs, comments, pinned SHAs, docker and
# expression refs, credential names, array and scalar runs-on forms).
VIEWS["fx_workflow_extra"] = """
SELECT 'repo-' || source AS repo, doc_id + 1000000000 AS line_no,
       CASE doc_id % 13
         WHEN 0 THEN '      - uses: actions/setup-python@v5'
         WHEN 1 THEN '        uses: ''docker://alpine:3'''
         WHEN 2 THEN '    uses: "org/action@' || md5(CAST(doc_id AS STRING)) || substr(md5(lang), 1, 8) || '" # pinned'
         WHEN 3 THEN '      AWS_ACCESS_KEY_ID: ${{ secrets.KEY }}'
         WHEN 4 THEN '      aws-session-token: x'
         WHEN 5 THEN '  runs-on: "ubuntu-22.04"'
         WHEN 6 THEN '  runs-on: [ self-hosted , "cipool", large ]'
         WHEN 7 THEN '  runs-on: [self-hosted, daytona]'
         WHEN 8 THEN '  runs-on: blacksmith-4vcpu-ubuntu-2204  '
         WHEN 9 THEN '  runs-on: macos-latest'
         WHEN 10 THEN '    uses: ${{ matrix.action }}'
         WHEN 11 THEN '    uses: actions/cache@v4 # comment'
         ELSE 'runs-on: ' END AS text
FROM documents
"""


# Fleet manifest rows (one per supplier) with deliberate configuration faults.
VIEWS["fx_fleets"] = """
SELECT s_suppkey AS fleet_pos,
  CASE WHEN s_suppkey % 19 = 0 THEN 'Fleet_' || CAST(s_suppkey AS STRING) ELSE 'fleet-' || CAST(s_suppkey % 90 AS STRING) END AS fleet,
  CASE WHEN s_suppkey % 29 = 0 THEN 'enterprise' WHEN s_suppkey % 3 = 0 THEN 'repository' ELSE 'organization' END AS scope,
  CASE WHEN s_suppkey % 23 = 0 THEN '-bad' ELSE 'Org-' || CAST(s_nationkey AS STRING) END AS owner,
  CASE WHEN s_suppkey % 27 = 0 THEN '/etc/' WHEN s_suppkey % 28 = 0 THEN '../' ELSE '' END
    || 'profiles/' || CAST(s_suppkey AS STRING) || '.toml' AS profile,
  CASE WHEN s_suppkey % 25 = 0 THEN 'repository' WHEN s_suppkey % 3 = 0 THEN 'repository' WHEN s_suppkey % 5 = 0 THEN NULL
       ELSE 'organization' END AS profile_scope,
  CASE WHEN s_suppkey % 24 = 0 THEN NULL ELSE 'Org-' || CAST(s_nationkey AS STRING) END AS profile_owner,
  CASE WHEN s_suppkey % 26 = 0 THEN 'x1' WHEN s_suppkey % 32 = 0 THEN NULL ELSE CAST(s_suppkey AS STRING) END AS installation_key,
  CASE WHEN s_suppkey % 6 = 0 THEN 'edge-' || CAST(s_suppkey % 3 AS STRING) END AS routing_labels,
  CASE s_suppkey % 4 WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'am-1' WHEN 2 THEN 'us' ELSE 'Eu_1' END AS target,
  CASE WHEN s_suppkey % 17 = 0 THEN 'https://app.daytona.io/api/' WHEN s_suppkey % 31 = 0 THEN 'https://other.example/api'
       ELSE 'https://app.daytona.io/api' END AS api_base,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 11 = 0 THEN '' ELSE 'vol-' || CAST(s_suppkey * 7 % 400 AS STRING) END AS cache_volume,
  CASE WHEN s_suppkey % 7 = 0 THEN 'daytona' WHEN s_suppkey % 7 = 1 THEN 'edge-ci' WHEN s_suppkey % 7 = 2 THEN 'Bad Name' END AS runner_group,
  CASE WHEN s_suppkey % 7 IN (1, 3) THEN s_suppkey % 4 END AS runner_group_id,
  s_suppkey % 90 AS poll_interval_secs,
  s_suppkey % 11 - 1 AS request_spacing_secs,
  CASE WHEN s_suppkey % 13 = 0 THEN 'allow' WHEN s_suppkey % 2 = 0 THEN 'deny-by-default' END AS network_policy,
  CASE s_suppkey % 6 WHEN 0 THEN '10.0.0.0/8,192.168.1.0/24' WHEN 1 THEN '10.0.0.1/8' WHEN 2 THEN '8.8.8.0/24'
       WHEN 3 THEN '172.16.0.0/12,172.16.0.0/12' WHEN 4 THEN '10.1.0.0/16,10.2.0.0/16,10.3.0.0/16,10.4.0.0/16,10.5.0.0/16,10.6.0.0/16'
       ELSE CASE s_suppkey % 5 WHEN 0 THEN '192.168.0.0/33' WHEN 1 THEN '10.0.0.1,10.0.0.0/255.0.0.0'
            WHEN 2 THEN '10.0.0.0/255.0.0.0,10.0.0.0/8' WHEN 3 THEN '10.0.0.0/0.255.255.255' ELSE '10.0.0.0/255.0.255.0' END END
       AS cidr_allow_list,
  CASE s_suppkey % 4 WHEN 0 THEN 'github.com,*.githubusercontent.com' WHEN 1 THEN 'GitHub.com,github.com'
       WHEN 2 THEN 'bad_domain' ELSE 'pypi.org' END AS domain_allow_list
FROM supplier
"""

# Size classes declared by each fleet profile.
VIEWS["fx_fleet_classes"] = """
SELECT 'profiles/' || CAST(p_partkey % 100 AS STRING) || '.toml' AS profile, p_partkey AS class_pos,
  CASE WHEN p_partkey % 100 < 50 AND p_partkey < 100 THEN 'default' WHEN p_partkey % 100 < 80 AND p_partkey < 200 THEN 'large'
       ELSE 'c' || CAST(p_partkey % 7 AS STRING) END AS name,
  CASE WHEN p_partkey % 9 = 0 THEN 'self-hosted,pool' WHEN p_partkey % 31 = 0 THEN NULL
       WHEN p_partkey % 8 = 0 THEN 'self-hosted,edge-0' WHEN p_partkey % 10 = 1 THEN 'self-hosted,cipool,edge-0'
       ELSE 'self-hosted,daytona,' || p_type END AS labels,
  CASE WHEN p_partkey % 35 = 0 THEN NULL WHEN p_partkey % 36 = 0 THEN ' ' ELSE p_name || ' ' || CAST(p_partkey % 50 AS STRING) END AS snapshot,
  CASE WHEN p_partkey % 33 = 0 THEN NULL ELSE p_size % 4 - 1 END AS min_idle,
  CASE WHEN p_partkey % 34 = 0 THEN NULL ELSE p_size % 9 END AS max_live,
  CASE WHEN p_size % 3 = 0 THEN 'warm pool for bursts' WHEN p_size % 7 = 0 THEN '  ' END AS warm_floor_reason
FROM part
"""

# Provider targets (one per supplier): ids and names, some shared.
VIEWS["fx_regions"] = """
SELECT CASE s_suppkey % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'eu' ELSE 'rg-' || CAST(s_suppkey AS STRING) END AS id,
       CASE WHEN s_suppkey % 5 = 0 THEN 'AFRICA' ELSE 'region-' || CAST(s_suppkey AS STRING) END AS name
FROM supplier
"""

VIEWS["fx_volumes"] = """
SELECT p_partkey AS pos, 'v-' || CAST(p_partkey AS STRING) AS id, 'vol-' || CAST(p_partkey % 300 AS STRING) AS name FROM part
"""

# Repository rulesets: what exists and what the bootstrap wants.
VIEWS["fx_rulesets_actual"] = """
SELECT 'rule-' || CAST(s_suppkey AS STRING) AS name,
       CASE s_suppkey % 3 WHEN 1 THEN 'tag' ELSE 'branch' END AS target,
       CASE WHEN s_suppkey % 5 = 0 THEN 'Organization' ELSE 'Repository' END AS source_type,
       CASE WHEN s_suppkey % 4 = 0 THEN 'evaluate' ELSE 'active' END AS enforcement
FROM supplier
"""

VIEWS["fx_rulesets_desired"] = """
SELECT 'rule-' || CAST(s_suppkey + 30 AS STRING) AS name, 'branch' AS target, 'Repository' AS source_type,
       'active' AS enforcement
FROM supplier
"""


def fixture_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Bind a (stateless, single-table) fixture view to a file *stream* of
    its driver table, for the Structured Streaming operators."""
    from ..streaming.runner import stream_source
    text = VIEWS[name].replace("{", "{{").replace("}", "}}")
    tables = view_tables(name)
    if len(tables) != 1:
        raise ValueError(f"{name} reads {tables}; streams bind one table")
    t = tables[0]
    text = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: stream_source(spark, f"{sf_dir.rstrip('/')}/{t}.parquet")})


# Fleet profile sections flattened to columns (lists as comma text), with
# faults: bad manifest versions, unknown and credential-like keys, bad
# repository names, shared routing labels, bad ports and lifecycle values.
VIEWS["fx_profiles"] = """
SELECT s_suppkey AS fleet_pos, 'profiles/' || CAST(s_suppkey AS STRING) || '.toml' AS profile,
  CASE WHEN s_suppkey % 37 = 0 THEN 2 ELSE 1 END AS manifest_version,
  CASE WHEN s_suppkey % 3 = 0 THEN 'repository' ELSE 'organization' END AS scope,
  'Org-' || CAST(s_nationkey AS STRING) AS owner,
  CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'app,.github,Tools' WHEN 2 THEN 'api,API' WHEN 3 THEN '.hidden,web'
       ELSE 'svc-' || CAST(s_suppkey AS STRING) END AS repositories,
  CASE WHEN s_suppkey % 10 < 7 THEN 'deny-by-default' END AS network_policy,
  CASE s_suppkey % 7 WHEN 0 THEN 'edge-' || CAST(s_suppkey AS STRING) WHEN 1 THEN 'self-hosted' WHEN 2 THEN 'gpu,gpu' WHEN 3 THEN 'Bad_Label'
       WHEN 4 THEN 'other,edge-' || CAST(s_suppkey AS STRING) WHEN 5 THEN '' END AS routing_labels,
  CASE WHEN s_suppkey % 11 <> 0 THEN 'edge-' || CAST(s_suppkey AS STRING) END AS runner_group,
  CASE s_suppkey % 8 WHEN 0 THEN 'github.scope,daytona.api_key,lifecycle.idle_poll_secs' WHEN 1 THEN 'github.scope,notify.Webhook_Token'
       WHEN 2 THEN 'github.scope,poller.interval_secs' WHEN 3 THEN 'poller.interval_secs,poller.colour'
       WHEN 4 THEN 'github.owner,webhook.listen' WHEN 5 THEN 'watchdog.enabled' WHEN 6 THEN 'other.anything,routing.required_labels,network.policy' WHEN 7 THEN 'network.cidr_allow_list,network.bogus'
       ELSE 'github.scope,lifecycle.job_max_secs' END AS config_paths,
  CASE WHEN s_suppkey % 13 = 0 THEN -1 END AS hold_on_failure_secs, CASE WHEN s_suppkey % 17 = 0 THEN 0 ELSE 5 END AS fast_idle_poll_secs,
  CASE WHEN s_suppkey % 19 = 0 THEN -5 ELSE 90 END AS fast_idle_window_secs, s_suppkey % 40 - 1 AS job_max_secs,
  s_suppkey % 41 - 1 AS demand_idle_secs, CASE WHEN s_suppkey % 42 = 0 THEN -2 END AS auto_stop_minutes,
  s_suppkey % 7 - 1 AS idle_refresh_secs, s_suppkey % 5 AS idle_poll_secs, s_suppkey % 9 AS busy_poll_secs,
  CASE WHEN s_suppkey % 10 = 0 THEN 'yes' ELSE 'true' END AS watchdog_enabled,
  CASE WHEN s_suppkey % 12 = 0 THEN '0.0.0.0' WHEN s_suppkey % 21 = 0 THEN 'example.org' WHEN s_suppkey % 22 = 0 THEN NULL
       WHEN s_suppkey % 25 <> 3 THEN '127.0.0.1' END AS listen_host,
  CASE WHEN s_suppkey % 14 = 0 THEN 70000 WHEN s_suppkey % 25 <> 3 THEN 8080 + s_suppkey % 10 END AS listen_port,
  CASE WHEN s_suppkey % 25 = 3 OR s_suppkey % 27 = 0 THEN NULL WHEN s_suppkey % 15 = 0 THEN 'BAD-NAME' WHEN s_suppkey % 23 = 0 THEN '_LEADING' WHEN s_suppkey % 29 = 0 THEN 'A' || repeat('B', 64) ELSE 'FLEET_WEBHOOK_SECRET' END AS secret_env,
  CASE WHEN s_suppkey % 16 = 0 THEN NULL ELSE s_suppkey + 1000 END AS installation_id,
  CASE WHEN s_suppkey % 24 = 0 THEN s_suppkey ELSE s_suppkey + 1000 END AS configured_installation_id,
  CASE WHEN s_suppkey % 3 = 0 THEN 'User' ELSE 'Organization' END AS target_type,
  CASE WHEN s_suppkey % 18 = 0 THEN 'someone-else' ELSE 'org-' || CAST(s_nationkey AS STRING) END AS login,
  CASE WHEN s_suppkey % 20 = 0 THEN 'selected' ELSE 'all' END AS repository_selection
FROM supplier
"""

# Profile documents as JSON text, one per customer: sections and keys that are
# absent, null or of a wrong type, unknown and credential-like keys at several
# depths, nested lists, texts that are no JSON.
VIEWS["fx_profile_documents"] = """
SELECT c_custkey AS profile_no,
  CASE WHEN c_custkey % 3 = 0 THEN 'repository' ELSE 'organization' END AS scope,
  'Org-' || CAST(c_nationkey AS STRING) AS owner,
  CASE WHEN c_custkey % 53 = 0 THEN NULL WHEN c_custkey % 59 = 0 THEN 'not json' WHEN c_custkey % 61 = 0 THEN '[{"github":{}}]' ELSE
  '{"title":"p [' || CAST(c_custkey AS STRING) || '"'
  || CASE WHEN c_custkey % 31 = 0 THEN '' WHEN c_custkey % 37 = 0 THEN ',"github":"none"' WHEN c_custkey % 3 = 0 THEN
     ',"github":{"scope":"repository","owner":"Org-' || CAST(c_nationkey AS STRING) || '"'
     || CASE c_custkey % 5 WHEN 0 THEN ',"runner_group":"edge-' || CAST(c_custkey % 4 AS STRING) || '"' WHEN 1 THEN ',"runner_group_id":'
        || CAST(c_custkey % 4 AS STRING) WHEN 2 THEN ',"runner_group_id":"7","runner_group":null' WHEN 3 THEN ',"runner_group":"Bad Name"' ELSE '' END
     || CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN ',"repositories":[]' WHEN 2 THEN ',"repositories":"app"'
        WHEN 3 THEN ',"repositories":["app",7]' WHEN 4 THEN ',"repositories":["api","API"]' ELSE ',"repositories":["app",".github"]' END || '}'
     ELSE ',"github":{"org":"' || CASE WHEN c_custkey % 23 = 0 THEN 'Other' ELSE 'Org-' || CAST(c_nationkey AS STRING) END || '"'
     || CASE c_custkey % 6 WHEN 4 THEN ',"scope":"repository"' WHEN 1 THEN ',"scope":"organization"' WHEN 2 THEN ',"repositories":[]' ELSE '' END
     || CASE c_custkey % 8 WHEN 0 THEN '' WHEN 1 THEN ',"runner_group":"other"' ELSE ',"runner_group":"daytona"' END || '}' END
  || CASE c_custkey % 11 WHEN 0 THEN '' WHEN 1 THEN ',"daytona":{}' WHEN 2 THEN ',"daytona":{"target":9}' WHEN 3 THEN ',"daytona":{"target":"Eu_1"}'
     WHEN 4 THEN ',"daytona":{"target":"us","deep":[{"x":[[{"api-key":1}]]}]}' ELSE ',"daytona":{"target":"us"}' END
  || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE CASE c_custkey % 13 WHEN 0 THEN ',"network":null' WHEN 1 THEN ',"network":[]' WHEN 2 THEN ',"network":{}'
     WHEN 3 THEN ',"network":{"policy":"allow","cidr_allow_list":["10.0.0.0/8"],"domain_allow_list":[],"bogus":1}'
     WHEN 4 THEN ',"network":{"policy":"deny-by-default","cidr_allow_list":"10.0.0.0/8","domain_allow_list":["pypi.org",3]}'
     WHEN 5 THEN ',"network":{"policy":"deny-by-default","cidr_allow_list":["8.8.8.0/24","10.0.0.1/8"],"domain_allow_list":["a.org","A.org"]}'
     WHEN 6 THEN ',"network":{"policy":"deny-by-default","cidr_allow_list":["10.0.0.0/8",5,"10.0.0.0/8"],"domain_allow_list":["bad_domain"]}'
     WHEN 7 THEN ',"network":{"policy":true,"cidr_allow_list":[],"domain_allow_list":["pypi.org"]}' ELSE
     ',"network":{"policy":"deny-by-default","cidr_allow_list":["10.0.0.0/8","192.168.0.0/16"],"domain_allow_list":["pypi.org","*.b.org"]}' END END
  || CASE c_custkey % 10 WHEN 0 THEN '' WHEN 1 THEN ',"routing":{}' WHEN 2 THEN ',"routing":null' WHEN 3 THEN ',"routing":{"required_labels":["large"],"more":1}'
     WHEN 4 THEN '' WHEN 5 THEN ',"routing":{"required_labels":["edge-' || CAST(c_custkey % 4 AS STRING) || '"]}' WHEN 6 THEN '' WHEN 7 THEN ',"routing":{"required_labels":["x","x","No"]}'
     WHEN 8 THEN '' ELSE ',"routing":{"required_labels":[]}' END
  || CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN ',"cache":{}' WHEN 2 THEN ',"cache":{"volume":"  "}' WHEN 3 THEN ',"cache":true'
     WHEN 4 THEN ',"cache":{"volume":4}' ELSE ',"cache":{"volume":"v"}' END
  || CASE c_custkey % 9 WHEN 0 THEN '' WHEN 1 THEN ',"poller":{}' WHEN 2 THEN ',"poller":{"interval_secs":1.5}' WHEN 3 THEN ',"poller":{"interval_secs":30}'
     WHEN 4 THEN ',"poller":{"interval_secs":0,"request_spacing_secs":-1}' WHEN 5 THEN ',"poller":{"interval_secs":"60","colour":2}'
     WHEN 6 THEN ',"poller":{"interval_secs":90,"request_spacing_secs":null}' WHEN 7 THEN ',"poller":7' ELSE ',"poller":{"interval_secs":60,"request_spacing_secs":0}' END
  || CASE c_custkey % 12 WHEN 0 THEN '' WHEN 1 THEN ',"webhook":{}' WHEN 2 THEN ',"webhook":{"listen":8080}' WHEN 3 THEN ',"webhook":{"listen":"localhost"}'
     WHEN 4 THEN ',"webhook":{"listen":" LocalHost :80"}' WHEN 5 THEN ',"webhook":{"listen":"::1:99999"}' WHEN 6 THEN ',"webhook":{"listen":"example.org:80"}'
     WHEN 7 THEN ',"webhook":{"listen":"0.0.0.0:http"}' WHEN 8 THEN ',"webhook":{"listen":"127.0.0.1:8080","hmac_env":"bad-name"}'
     WHEN 9 THEN ',"webhook":{"listen":"127.0.0.1:8080","hmac_env":3,"secret":"s"}' ELSE ',"webhook":{"listen":"127.0.0.1:8080","hmac_env":"HOOK"}' END
  || CASE c_custkey % 8 WHEN 0 THEN '' WHEN 1 THEN ',"lifecycle":[1]' WHEN 2 THEN ',"lifecycle":{"ephemeral":true,"idle_poll_secs":0}'
     WHEN 3 THEN ',"lifecycle":{"job_max_secs":-1,"busy_poll_secs":null}' WHEN 4 THEN ',"lifecycle":{"idle_refresh_secs":"5","colour":"red"}'
     ELSE ',"lifecycle":{"hold_on_failure_secs":900,"fast_idle_poll_secs":5}' END
  || CASE c_custkey % 7 WHEN 0 THEN ',"watchdog":{"github_queue_scan":"yes"}' WHEN 1 THEN ',"watchdog":{"github_queue_scan":false,"Auth_Token":{"a":1}}' ELSE '' END
  || CASE c_custkey % 14 WHEN 0 THEN '' WHEN 1 THEN ',"size_class":{}' WHEN 2 THEN ',"size_class":[]' WHEN 3 THEN ',"size_class":["default",{"name":"large"}]'
     ELSE ',"size_class":[{"name":"default","labels":["self-hosted","daytona"],"snapshot":"s1","min_idle":' || CASE c_custkey % 5 WHEN 0 THEN '"0"' WHEN 1 THEN 'true' ELSE '1' END
     || ',"max":3,"warm_floor_reason":"bursts"},{"name":"large","labels":["self-hosted",' || CASE c_custkey % 6 WHEN 0 THEN '""' WHEN 1 THEN '5' ELSE '"daytona","large"' END
     || '],"snapshot":' || CASE c_custkey % 4 WHEN 0 THEN 'null' ELSE '"s2"' END || ',"min_idle":0,"max":2}]' END
  || '}' END AS body
FROM customer
"""

# Fleet manifests as JSON text, one per supplier, three entries each.
VIEWS["fx_manifests"] = """
SELECT s_suppkey AS manifest_no,
  CASE WHEN s_suppkey % 41 = 0 THEN NULL WHEN s_suppkey % 17 = 0 THEN '{"manifest":{"version":1},"fleet":[]}' WHEN s_suppkey % 19 = 0 THEN '{"fleet":{}}' ELSE
  '{"manifest":{"version":' || CASE s_suppkey % 7 WHEN 0 THEN '2' WHEN 1 THEN '"1"' WHEN 2 THEN 'true' ELSE '1' END || '},"fleet":['
  || '{"name":"alder","organization":"Org-' || CAST(s_nationkey AS STRING) || '","profile":"config/fleets/alder/runners.toml","installation_id_key":"'
  || CASE s_suppkey % 5 WHEN 0 THEN '0' ELSE CAST(s_suppkey AS STRING) END || '"' || CASE s_suppkey % 6 WHEN 0 THEN ',"owner":"x"' WHEN 1 THEN ',"colour":1' ELSE '' END || '},'
  || '{"name":"' || CASE s_suppkey % 4 WHEN 0 THEN 'alder' WHEN 1 THEN 'Birch' ELSE 'birch' END || '","scope":"repository","owner":"'
  || CASE s_suppkey % 3 WHEN 0 THEN '-bad' ELSE 'me' END || '","profile":"config/fleets/birch/runners.toml"' || CASE s_suppkey % 8 WHEN 0 THEN '' ELSE ',"installation_id_key":"12"' END || '},'
  || CASE s_suppkey % 10 WHEN 0 THEN '"cedar"' WHEN 1 THEN '{"name":"cedar","scope":"enterprise","other":1}' WHEN 2 THEN '{"name":3,"scope":null,"profile":true}'
     ELSE '{"name":"cedar","scope":"repository","owner":"ME","profile":"/etc/cedar","installation_id_key":5}' END || ']}' END AS body
FROM supplier
"""


# Fleets that referenced each snapshot: one to three of the instances.
VIEWS["fx_snapshot_fleets"] = """
SELECT DISTINCT 'snapshot-' || CAST(p_partkey AS STRING) AS snapshot_id,
       CASE WHEN k.k = 3 AND p_partkey % 4 = 0 THEN 'retired' ELSE 'inst-' || CAST((p_partkey + k.k) % 4 AS STRING) END AS fleet
FROM part, (VALUES (1), (2), (3)) AS k(k) WHERE k.k <= p_partkey % 3 + 1
"""

# Reference history per snapshot (days unreferenced at as_of, failed build,
# replacement snapshot, incident state) for the retirement policy.
VIEWS["fx_snapshot_history"] = """
SELECT 'snapshot-' || CAST(p_partkey AS STRING) AS snapshot_id,
       CASE WHEN p_partkey % 43 = 0 THEN NULL ELSE p_partkey % 60 END AS unreferenced_days,
       p_type = 'SMALL' AS build_failed,
       CASE p_partkey % 5 WHEN 0 THEN 'snap-click' WHEN 1 THEN 'snap-view' WHEN 2 THEN 'snap-missing' ELSE NULL END AS replacement,
       CASE WHEN p_partkey % 17 = 0 THEN 'open' WHEN p_partkey % 19 = 0 THEN 'resolved' ELSE NULL END AS incident,
       CASE WHEN p_partkey % 19 = 0 THEN p_partkey % 10 END AS incident_resolved_days
FROM part
"""
