"""Registered snapshot-audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import audit as au
from ..sources.fixtures import fixture, oracle_with


def snaps_typed(spark, sf):
    """Typed inventory from ``fx_snapshots`` (regions comma text -> sorted array)."""
    s = fixture(spark, sf, "fx_snapshots")
    regions = F.array_sort(F.filter(F.split("region_ids", ","), lambda x: x != ""))
    return s.withColumn("region_ids", regions)


def snaps_json(spark, sf):
    return au.normalize_snapshot(fixture(spark, sf, "fx_snapshot_json"), keep=["pos"])


def refs_df(spark, sf):
    return fixture(spark, sf, "fx_profile_refs").withColumn("profile", F.concat(F.col("fleet"), F.lit("/runners")))


# ---------------------------------------------------------------- oracle helpers

def _jt(p: str) -> str:
    return f"json_type(raw, '{p}')"


def _str(p: str) -> str:
    return f"CASE WHEN {_jt(p)} = 'VARCHAR' THEN nullif(json_extract_string(raw, '{p}'), '') END"


def _num(p: str) -> str:
    v = f"CAST(json_extract(raw, '{p}') AS DOUBLE)"
    return f"CASE WHEN {_jt(p)} IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND {v} >= 0 AND NOT isinf({v}) THEN {v} END"


def _first(conv, *paths: str) -> str:
    whens = " ".join(f"WHEN {_jt(p)} IS NOT NULL THEN {conv(p)}" for p in paths)
    return f"CASE {whens} END"


_REF = (f"CASE WHEN {_jt('$.ref')} IS NOT NULL THEN {_str('$.ref')} "
        f"WHEN {_jt('$.buildInfo')} IS NOT NULL THEN {_first(_str, '$.buildInfo.snapshotRef', '$.buildInfo.snapshot_ref')} "
        f"ELSE {_first(_str, '$.build_info.snapshotRef', '$.build_info.snapshot_ref')} END")
_REGIONS = """array_to_string(CASE WHEN json_type(arr) = 'ARRAY' THEN list_sort(list_filter(list_transform(
    json_extract(arr, '$[*]'), lambda e: CASE WHEN json_type(e) = 'VARCHAR' THEN json_extract_string(e, '$') END),
    lambda s: s IS NOT NULL AND s <> '')) ELSE [] END, ',')"""
_NORM = f"""
norm AS (SELECT pos, {_str('$.id')} AS snapshot_id, {_str('$.name')} AS name, {_str('$.state')} AS state,
  {_num('$.size')} AS size, {_first(_str, '$.createdAt', '$.created_at')} AS created_at,
  {_first(_str, '$.imageName', '$.image_name', '$.image')} AS image_name, {_REF} AS snapshot_ref,
  {_first(_num, '$.cpu', '$.resources.cpu')} AS cpu, {_first(_num, '$.mem', '$.memory', '$.resources.memory')} AS memory_gib,
  {_first(_num, '$.disk', '$.resources.disk')} AS disk_gib, {_first(_num, '$.gpu', '$.resources.gpu')} AS gpu,
  {_first(_str, '$.sandboxClass', '$.sandbox_class')} AS sandbox_class, {_REGIONS} AS region_ids
FROM (SELECT pos, raw, CASE WHEN json_type(raw, '$.regionIds') IS NOT NULL THEN json_extract(raw, '$.regionIds')
                            ELSE json_extract(raw, '$.region_ids') END AS arr FROM fx_snapshot_json) x)"""

register("normalize_snapshot", oracle_with(["fx_snapshot_json"], f", {_NORM} SELECT * FROM norm"))(
    lambda spark, sf: snaps_json(spark, sf).drop("is_object").withColumn("region_ids", F.array_join("region_ids", ",")))

register("duplicate_ids", oracle_with(["fx_snapshot_json"], f"""
, {_NORM} SELECT snapshot_id, count(*) AS occurrences FROM norm WHERE snapshot_id IS NOT NULL
GROUP BY snapshot_id HAVING count(*) > 1"""))(lambda spark, sf: au.duplicate_ids(snaps_json(spark, sf)))

_PAYLOAD_ERR = "payload holds neither a list of items nor an object with one"


def _payload(spark, sf):
    """Wrap each raw item as a provider response (bare array, ``items``
    object, or a malformed object), read it back and normalise the items."""
    raw = fixture(spark, sf, "fx_snapshot_json")
    payload = (F.when(F.col("pos") % 7 == 6, F.concat(F.lit('{"data":['), F.col("raw"), F.lit("]}")))
               .when(F.col("pos") % 2 == 0, F.concat(F.lit("["), F.col("raw"), F.lit("]")))
               .otherwise(F.concat(F.lit('{"items":['), F.col("raw"), F.lit("]}"))))
    items = au.read_snapshot_payload(raw.select("pos", payload.alias("payload")), keep=["pos"])
    norm = au.normalize_snapshot(items, keep=["pos", "error"])
    return norm.select("pos", "error", F.when(F.col("error").isNull(), F.col("snapshot_id")).alias("snapshot_id"))


register("read_snapshot_payload", oracle_with(["fx_snapshot_json"], f"""
, {_NORM}
SELECT pos, CASE WHEN pos % 7 = 6 THEN '{_PAYLOAD_ERR}' END AS error,
       CASE WHEN pos % 7 <> 6 THEN snapshot_id END AS snapshot_id FROM norm
"""))(_payload)


def _pages(spark, sf):
    items = fixture(spark, sf, "fx_snapshot_json")
    pages = items.groupBy("page").agg(F.collect_list("pos").alias("items"))  # <= 200 items per page
    return au.union_inventory_pages(pages).select("page", F.col("raw").alias("pos"))


register("union_inventory_pages", oracle_with(["fx_snapshot_json"], "SELECT page, pos FROM fx_snapshot_json"))(_pages)

register("page_consistency", oracle_with(["fx_inventory_pages"], """
, st AS (SELECT min(total_pages) AS lo, max(total_pages) AS hi, count(*) AS n FROM fx_inventory_pages)
SELECT 'invalid_total_pages' AS violation, position FROM fx_inventory_pages
 WHERE total_pages IS NULL OR total_pages < 1 OR total_pages > 1000
UNION ALL SELECT 'inconsistent_total_pages', CAST(NULL AS BIGINT) FROM st WHERE lo <> hi
UNION ALL SELECT 'page_out_of_order', position FROM fx_inventory_pages WHERE page IS NOT NULL AND page <> position
UNION ALL SELECT 'incomplete_pages', CAST(NULL AS BIGINT) FROM st WHERE lo = hi AND n <> hi
"""))(lambda spark, sf: au.page_consistency(fixture(spark, sf, "fx_inventory_pages")))

_SNP = """snp AS (SELECT snapshot_id, name, state, size, image_name, cpu, memory_gib, disk_gib, gpu, sandbox_class,
  array_to_string(list_sort(list_filter(string_split(region_ids, ','), lambda x: x <> '')), ',') AS regions_key
  FROM fx_snapshots)"""
_COLL = "coll AS (SELECT name AS snapshot_name, count(*) AS members FROM snp WHERE coalesce(name, '') <> '' GROUP BY name HAVING count(*) > 1)"
_KEY = "image_name, cpu, memory_gib, disk_gib, gpu, sandbox_class, regions_key"
_CAND = f"""keyed AS (SELECT * FROM snp WHERE coalesce(image_name, '') <> '' AND cpu IS NOT NULL AND memory_gib IS NOT NULL
              AND disk_gib IS NOT NULL AND gpu IS NOT NULL AND sandbox_class IS NOT NULL AND regions_key <> ''),
cand AS (SELECT {_KEY}, count(DISTINCT nullif(name, '')) AS distinct_names, count(*) AS members FROM keyed
         GROUP BY {_KEY} HAVING count(DISTINCT nullif(name, '')) > 1),
num AS (SELECT *, printf('candidate-%03d', row_number() OVER (ORDER BY concat_ws('|', image_name, CAST(cpu AS VARCHAR),
          CAST(memory_gib AS VARCHAR), CAST(disk_gib AS VARCHAR), CAST(gpu AS VARCHAR), sandbox_class, regions_key))) AS candidate_id
        FROM cand),
mem AS (SELECT num.candidate_id, k.snapshot_id, k.name, k.state, k.size FROM keyed k JOIN num USING ({_KEY}))"""
_REFS = "refs AS (SELECT snapshot, fleet, size_class FROM fx_profile_refs)"
_AUD_VIEWS = ["fx_snapshots", "fx_profile_refs"]


def _audit_parts(spark, sf):
    snaps = snaps_typed(spark, sf)
    refs = refs_df(spark, sf)
    coll = au.name_collisions(snaps)
    num = au.candidate_numbering(au.duplicate_candidates(snaps))
    members = au.candidate_members(snaps, num)
    return snaps, refs, coll, num, members


register("name_collisions", oracle_with(["fx_snapshots"], f", {_SNP}, {_COLL} SELECT * FROM coll"))(
    lambda spark, sf: au.name_collisions(snaps_typed(spark, sf)))

register("collision_members", oracle_with(["fx_snapshots"], f"""
, {_SNP}, {_COLL} SELECT name AS snapshot_name, snapshot_id FROM snp WHERE name IN (SELECT snapshot_name FROM coll)
"""))(lambda spark, sf: au.collision_members(snaps_typed(spark, sf), au.name_collisions(snaps_typed(spark, sf))))

register("duplicate_candidates", oracle_with(["fx_snapshots"], f", {_SNP}, {_CAND} SELECT * FROM cand"))(
    lambda spark, sf: au.duplicate_candidates(snaps_typed(spark, sf)))

register("candidate_numbering", oracle_with(["fx_snapshots"], f", {_SNP}, {_CAND} SELECT candidate_id, {_KEY} FROM num"))(
    lambda spark, sf: au.candidate_numbering(au.duplicate_candidates(snaps_typed(spark, sf)))
    .select("candidate_id", *au.CANDIDATE_KEY))

register("candidate_members", oracle_with(["fx_snapshots"], f", {_SNP}, {_CAND} SELECT * FROM mem"))(
    lambda spark, sf: _audit_parts(spark, sf)[4])

_ROLLUP = f""", {_SNP}, {_CAND}, {_REFS},
fl AS (SELECT candidate_id, list_sort(list(DISTINCT fleet)) AS fleets FROM (
         SELECT DISTINCT m.candidate_id, r.fleet FROM (SELECT DISTINCT candidate_id, coalesce(name, '') AS nm FROM mem) m
         JOIN refs r ON r.snapshot = m.nm) GROUP BY candidate_id),
roll AS (SELECT b.candidate_id, b.members, b.all_active, coalesce(fl.fleets, []) AS fleets,
                len(coalesce(fl.fleets, [])) > 1 AS shared_candidate,
                CASE WHEN b.n_size = b.members AND b.lo = b.hi THEN b.lo * (b.members - 1) END AS potential_reclaimable_size
         FROM (SELECT candidate_id, count(*) AS members, bool_and(lower(coalesce(state, '')) = 'active') AS all_active,
                      count(size) AS n_size, min(size) AS lo, max(size) AS hi FROM mem GROUP BY candidate_id) b
         LEFT JOIN fl USING (candidate_id))
"""


def _rollup(spark, sf):
    snaps, refs, coll, num, members = _audit_parts(spark, sf)
    return au.candidate_rollup(members, refs)


register("candidate_rollup", oracle_with(_AUD_VIEWS, _ROLLUP + """
SELECT candidate_id, members, all_active, array_to_string(fleets, ',') AS fleets, shared_candidate,
       potential_reclaimable_size FROM roll"""))(
    lambda spark, sf: _rollup(spark, sf).withColumn("fleets", F.array_join("fleets", ",")))

register("snapshot_rows", oracle_with(_AUD_VIEWS, f"""
, {_SNP}, {_REFS},
rc AS (SELECT snapshot, count(*) AS n, count(DISTINCT fleet) AS fleets FROM refs GROUP BY snapshot)
SELECT s.snapshot_id, s.name, s.state, s.size, s.image_name, s.cpu, s.memory_gib, s.disk_gib, s.gpu, s.sandbox_class,
       coalesce(rc.n, 0) AS n_references,
       coalesce(rc.fleets, 0) AS n_fleets
FROM snp s LEFT JOIN rc ON rc.snapshot = coalesce(s.name, '')
"""))(lambda spark, sf: _snapshot_rows(spark, sf))


def _snapshot_rows(spark, sf):
    """The report's snapshot rows with their references counted (the reference rows are a section of their own)."""
    refs = refs_df(spark, sf)
    rows = snaps_typed(spark, sf)
    named = au.references_of(rows, refs).groupBy("snapshot").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("fleet").alias("f"))
    return (rows.join(named, F.coalesce(rows["name"], F.lit("")) == named["snapshot"], "left")
            .select("snapshot_id", "name", "state", "size", "image_name", "cpu", "memory_gib", "disk_gib", "gpu", "sandbox_class",
                    F.coalesce("n", F.lit(0)).alias("n_references"), F.coalesce("f", F.lit(0)).alias("n_fleets")))


register("unresolved_refs", oracle_with(_AUD_VIEWS, f"""
, {_SNP}, {_REFS} SELECT snapshot, fleet, size_class FROM refs
WHERE snapshot NOT IN (SELECT name FROM snp WHERE coalesce(name, '') <> '')
"""))(lambda spark, sf: au.unresolved_refs(refs_df(spark, sf), snaps_typed(spark, sf)).select("snapshot", "fleet", "size_class"))

register("unreferenced_snapshots", oracle_with(_AUD_VIEWS, f"""
, {_SNP}, {_REFS} SELECT snapshot_id, name FROM snp WHERE coalesce(name, '') NOT IN (SELECT snapshot FROM refs)
"""))(lambda spark, sf: au.unreferenced_snapshots(snaps_typed(spark, sf), refs_df(spark, sf)))

_STATUS = f""", {_SNP}, {_CAND}, {_COLL}, {_REFS},
rn AS (SELECT snapshot, count(*) AS n FROM refs GROUP BY snapshot),
status AS (SELECT s.snapshot_id, s.name, coalesce(rn.n, 0) AS "references",
       CASE WHEN s.name IN (SELECT snapshot_name FROM coll) THEN 'ambiguous_name_collision'
            WHEN coalesce(rn.n, 0) > 0 THEN 'referenced' ELSE 'unreferenced' END AS reference_status,
       m.candidate_id AS duplicate_candidate
FROM snp s LEFT JOIN rn ON rn.snapshot = coalesce(s.name, '')
LEFT JOIN mem m ON m.snapshot_id IS NOT DISTINCT FROM s.snapshot_id AND m.name IS NOT DISTINCT FROM s.name)
"""


def _status(spark, sf):
    snaps, refs, coll, num, members = _audit_parts(spark, sf)
    return au.snapshot_reference_status(snaps, refs, coll, members)


register("snapshot_reference_status", oracle_with(_AUD_VIEWS, _STATUS + "SELECT * FROM status"))(_status)


def _summary(spark, sf):
    snaps, refs, coll, num, members = _audit_parts(spark, sf)
    return au.audit_summary(au.snapshot_reference_status(snaps, refs, coll, members),
                            au.unresolved_refs(refs, snaps), au.unreferenced_snapshots(snaps, refs),
                            coll, au.candidate_rollup(members, refs))


register("audit_summary", oracle_with(_AUD_VIEWS, _STATUS + _ROLLUP.replace(
    f", {_SNP}, {_CAND}, {_REFS},", ",", 1) + """
SELECT (SELECT count(*) FROM status) AS snapshot_count,
       (SELECT count(*) FROM status WHERE reference_status = 'referenced') AS referenced_snapshot_count,
       (SELECT count(*) FROM status WHERE reference_status = 'ambiguous_name_collision') AS ambiguous_snapshot_count,
       (SELECT count(*) FROM snp WHERE coalesce(name, '') NOT IN (SELECT snapshot FROM refs)) AS unreferenced_snapshot_count,
       (SELECT count(DISTINCT snapshot) FROM refs WHERE snapshot NOT IN (SELECT name FROM snp WHERE coalesce(name, '') <> ''))
         AS unresolved_profile_reference_count,
       (SELECT count(*) FROM coll) AS name_collision_count,
       (SELECT count(*) FROM roll) AS duplicate_candidate_count,
       (SELECT count(*) FROM roll WHERE shared_candidate) AS shared_candidate_count
"""))(_summary)

register("inventory_order", oracle_with(["fx_snapshots"], "SELECT snapshot_id, name FROM fx_snapshots"))(
    lambda spark, sf: au.inventory_order(snaps_typed(spark, sf)).select("snapshot_id", "name"))


def _regions(spark, sf):
    r = fixture(spark, sf, "fx_regions")
    item = F.to_json(F.struct("id", "name"))
    payload = F.when(F.length("name") % 2 == 0, F.concat(F.lit("["), item, F.lit("]"))) \
        .otherwise(F.concat(F.lit('{"items":['), item, F.lit("]}")))
    items = au.read_items_payload(r.select(payload.alias("payload")))
    v = F.parse_json("raw")
    return items.select(F.variant_get(v, "$.id", "string").alias("id"), F.variant_get(v, "$.name", "string").alias("name"))


register("read_regions", oracle_with(["fx_regions"], "SELECT id, name FROM fx_regions"))(_regions)


def _retire(spark, sf):
    from ..operators import retirement as rt
    status = _status(spark, sf)
    history = fixture(spark, sf, "fx_snapshot_history")
    succ = rt.replacement_successes(fixture(spark, sf, "fx_cycles").withColumnRenamed("instance", "fleet"), history,
                                    fixture(spark, sf, "fx_snapshot_fleets"))
    return rt.retirement_candidates(status, history, succ)


register("retirement_candidates", oracle_with(_AUD_VIEWS + ["fx_snapshot_history", "fx_cycles", "fx_snapshot_fleets"], _STATUS + """,
per AS (SELECT snapshot AS replacement, instance AS fleet, count(*) AS n FROM fx_cycles WHERE outcome = 'job' GROUP BY ALL),
succ AS (SELECT a.snapshot_id, min(coalesce(per.n, 0)) AS successes FROM fx_snapshot_fleets a
         JOIN fx_snapshot_history h USING (snapshot_id) LEFT JOIN per ON per.replacement = h.replacement AND per.fleet = a.fleet
         GROUP BY a.snapshot_id),
h AS (SELECT h.*, s.successes FROM fx_snapshot_history h LEFT JOIN succ s USING (snapshot_id)),
j AS (SELECT st.snapshot_id, st.reference_status, h.* EXCLUDE (snapshot_id),
             CASE WHEN incident = 'resolved' THEN least(unreferenced_days, incident_resolved_days) ELSE unreferenced_days END AS age
      FROM status st LEFT JOIN h USING (snapshot_id)),
r AS (SELECT snapshot_id, CASE WHEN reference_status <> 'unreferenced' THEN reference_status
        WHEN unreferenced_days IS NULL OR build_failed IS NULL THEN 'ambiguous'
        WHEN incident = 'open' THEN 'open_incident'
        WHEN build_failed THEN CASE WHEN age >= 7 THEN 'failed_build' ELSE 'failed_build_recent' END
        WHEN replacement IS NOT NULL AND coalesce(successes, 0) >= 100 THEN CASE WHEN age >= 14 THEN 'replaced' ELSE 'replaced_recent' END
        WHEN age >= 30 THEN 'unreferenced_30d' ELSE 'unreferenced_recent' END AS reason FROM j)
SELECT snapshot_id, CASE WHEN reason IN ('failed_build', 'replaced', 'unreferenced_30d') THEN 'retire' ELSE 'retain' END AS decision,
       reason FROM r
"""))(_retire)
