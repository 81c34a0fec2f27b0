"""Snapshot inventory audit.

Inventory rows are normalised once (cache the result: six consumers).
Membership lists (ids of a name collision, members of a duplicate
candidate) stay *rows* keyed by group, never arrays gathered into one
task, so a group holding a third of the inventory still spreads over the
cluster.  Only fleet names (a configuration dimension) are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import MAX_TOTAL_PAGES  # noqa: F401
from .numbering import number_rows

CANDIDATE_KEY = ("image_name", "cpu", "memory_gib", "disk_gib", "gpu", "sandbox_class", "regions_key")

# ------------------------------------------------------------------ P15 / S3


def _v_string(x: Column) -> Column:
    """Non-empty JSON string, else null (numbers are not coerced)."""
    s = F.variant_get(x, "$", "string")
    return F.when((F.schema_of_variant(x) == "STRING") & (s != ""), s)


def _v_number(x: Column) -> Column:
    """Finite non-negative JSON number, else null (booleans and text rejected)."""
    kind = F.schema_of_variant(x)
    d = F.try_variant_get(x, "$", "double")
    is_num = kind.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return F.when(is_num & ~F.isnan(d) & (d >= 0) & (d < F.lit(float("inf"))), d)


def _v_object(x: Column) -> Column:
    return F.when(F.schema_of_variant(x).startswith("OBJECT"), x)


def normalize_snapshot(raw: DataFrame, json_col: str = "raw", keep: list[str] | None = None) -> DataFrame:
    """Typed snapshot rows from provider JSON objects.

    Alternate spellings are tried in the provider's order (camelCase, then
    snake_case, then nested ``resources`` / ``buildInfo``); a wrong type
    becomes null; regions are the sorted non-empty strings of a list.

    ``variant_get(..., 'variant')`` is SQL NULL for an absent key but a
    VARIANT null for a JSON null, so ``coalesce`` over the spellings is
    exactly "first *present* key".  The JSON is parsed once (behind a
    generator) and each field is extracted once before typing, so the
    expressions stay small and inside whole-stage codegen.
    """
    keep = keep or []
    parsed = raw.select(*keep, F.inline(F.array(F.struct(F.try_parse_json(F.col(json_col)).alias("_v")))))
    v = F.col("_v")

    def at(path: str, base: Column | None = None) -> Column:
        return F.variant_get(v if base is None else base, path, "variant")

    res = _v_object(at("$.resources"))
    build = _v_object(F.coalesce(at("$.buildInfo"), at("$.build_info")))
    fields = parsed.select(
        *keep, F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)).alias("is_object"),
        at("$.id").alias("_id"), at("$.name").alias("_name"), at("$.state").alias("_state"),
        at("$.size").alias("_size"), F.coalesce(at("$.createdAt"), at("$.created_at")).alias("_created"),
        F.coalesce(at("$.imageName"), at("$.image_name"), at("$.image")).alias("_image"),
        F.coalesce(at("$.ref"), at("$.snapshotRef", build), at("$.snapshot_ref", build)).alias("_ref"),
        F.coalesce(at("$.cpu"), at("$.cpu", res)).alias("_cpu"),
        F.coalesce(at("$.mem"), at("$.memory"), at("$.memory", res)).alias("_mem"),
        F.coalesce(at("$.disk"), at("$.disk", res)).alias("_disk"),
        F.coalesce(at("$.gpu"), at("$.gpu", res)).alias("_gpu"),
        F.coalesce(at("$.sandboxClass"), at("$.sandbox_class")).alias("_class"),
        F.coalesce(at("$.regionIds"), at("$.region_ids")).alias("_regions"))
    regions = F.col("_regions")
    region_arr = F.when(F.schema_of_variant(regions).startswith("ARRAY"),
                        F.variant_get(regions, "$", "array<variant>"))
    region_strs = F.filter(F.transform(region_arr, lambda e: _v_string(e)), lambda s: s.isNotNull())
    return fields.select(
        *keep, "is_object",
        _v_string(F.col("_id")).alias("snapshot_id"), _v_string(F.col("_name")).alias("name"),
        _v_string(F.col("_state")).alias("state"), _v_number(F.col("_size")).alias("size"),
        _v_string(F.col("_created")).alias("created_at"), _v_string(F.col("_image")).alias("image_name"),
        _v_string(F.col("_ref")).alias("snapshot_ref"), _v_number(F.col("_cpu")).alias("cpu"),
        _v_number(F.col("_mem")).alias("memory_gib"), _v_number(F.col("_disk")).alias("disk_gib"),
        _v_number(F.col("_gpu")).alias("gpu"), _v_string(F.col("_class")).alias("sandbox_class"),
        F.array_sort(F.coalesce(region_strs, F.array().cast("array<string>"))).alias("region_ids"),
    )


def read_snapshot_payload(payloads: DataFrame, json_col: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """S3: one row per item of a payload that is an array or an object with
    an ``items`` array; other payloads yield one row with ``error`` set."""
    keep = keep or []
    v = F.try_parse_json(F.col(json_col))
    kind = F.schema_of_variant(v)
    items_v = F.variant_get(v, "$.items", "variant")
    arr = (F.when(kind.startswith("ARRAY"), F.variant_get(v, "$", "array<variant>"))
           .when(kind.startswith("OBJECT") & F.schema_of_variant(items_v).startswith("ARRAY"),
                 F.variant_get(items_v, "$", "array<variant>")))
    err = F.when(arr.isNull(), F.lit("payload holds neither a list of items nor an object with one"))
    return (payloads.select(*keep, arr.alias("_items"), err.alias("error"))
            .select(*keep, "error", F.explode_outer("_items").alias("_item"))
            .select(*keep, "error", F.when(F.col("_item").isNotNull(), F.to_json(F.col("_item"))).alias("raw")))


# ------------------------------------------------------------------ S4 / A12


def union_inventory_pages(pages: DataFrame, items_col: str = "items") -> DataFrame:
    """Every item of every captured page, with its page number."""
    return pages.select("page", F.posexplode(items_col).alias("item_pos", "raw"))


def page_consistency(pages: DataFrame, max_pages: int = MAX_TOTAL_PAGES) -> DataFrame:
    """Violations among captured page headers (position, page, total_pages):
    total_pages must be an integer in 1..``max_pages`` and equal on every page, a
    reported page number must equal its position (an unreported one is
    accepted), and pages 1..N must all be present."""
    t = F.col("total_pages")
    bad_total = pages.filter(t.isNull() | (t < 1) | (t > max_pages) | (t != F.floor(t))).select(
        F.lit("invalid_total_pages").alias("violation"), F.col("position"))
    stats = pages.agg(F.min(t).alias("lo"), F.max(t).alias("hi"), F.count(F.lit(1)).alias("n"),
                      F.count_distinct("page").alias("distinct_pages"))
    mixed = stats.filter(F.col("lo") != F.col("hi")).select(F.lit("inconsistent_total_pages").alias("violation"),
                                                            F.lit(None).cast("long").alias("position"))
    # a page that does not report its number is accepted
    out_of_order = pages.filter(F.col("page").isNotNull() & (F.col("page") != F.col("position"))).select(
        F.lit("page_out_of_order").alias("violation"), F.col("position"))
    incomplete = stats.filter((F.col("lo") == F.col("hi")) & (F.col("n") != F.col("hi"))).select(
        F.lit("incomplete_pages").alias("violation"), F.lit(None).cast("long").alias("position"))
    return bad_total.unionByName(mixed).unionByName(out_of_order).unionByName(incomplete)


# ------------------------------------------------------------------ W8 / A13 / A14


def inventory_order(snaps: DataFrame) -> DataFrame:
    """Provider order (name, id) with nulls as ''; a range-partitioned sort."""
    return snaps.orderBy(F.coalesce("name", F.lit("")), F.coalesce("snapshot_id", F.lit("")))


def duplicate_ids(snaps: DataFrame) -> DataFrame:
    """Non-null ids seen more than once (each is a violation)."""
    return (snaps.filter(F.col("snapshot_id").isNotNull()).groupBy("snapshot_id")
            .agg(F.count(F.lit(1)).alias("occurrences")).filter(F.col("occurrences") > 1))


def name_collisions(snaps: DataFrame) -> DataFrame:
    """Non-empty names carried by more than one snapshot: (snapshot_name, members)."""
    return (snaps.filter(F.coalesce(F.col("name"), F.lit("")) != "")
            .groupBy(F.col("name").alias("snapshot_name")).agg(F.count(F.lit(1)).alias("members"))
            .filter(F.col("members") > 1))


def collision_members(snaps: DataFrame, collisions: DataFrame) -> DataFrame:
    """Member rows of each collision (snapshot_name, snapshot_id), not an array."""
    return (snaps.select(F.col("name").alias("snapshot_name"), "snapshot_id")
            .join(collisions.select("snapshot_name"), "snapshot_name", "left_semi"))


# ------------------------------------------------------------------ A15 / A16 / W4


def with_candidate_key(snaps: DataFrame) -> DataFrame:
    """Rows eligible for duplicate grouping, with the regions as a text key."""
    ok = (F.coalesce(F.col("image_name"), F.lit("")) != "") & F.col("cpu").isNotNull() \
        & F.col("memory_gib").isNotNull() & F.col("disk_gib").isNotNull() & F.col("gpu").isNotNull() \
        & F.col("sandbox_class").isNotNull() & (F.size("region_ids") > 0)
    return snaps.filter(ok).withColumn("regions_key", F.array_join(F.array_sort("region_ids"), ","))


def duplicate_candidates(snaps: DataFrame) -> DataFrame:
    """Shape groups holding more than one distinct non-empty name.

    Numbers are DOUBLE so 2 and 2.0 group together.  ``count(DISTINCT)``
    is planned as a two-level aggregate, so one huge group is still
    combined map-side.
    """
    keyed = with_candidate_key(snaps)
    return (keyed.groupBy(*CANDIDATE_KEY)
            .agg(F.count_distinct(F.nullif(F.col("name"), F.lit(""))).alias("distinct_names"),
                 F.count(F.lit(1)).alias("members"))
            .filter(F.col("distinct_names") > 1))


def candidate_numbering(candidates: DataFrame) -> DataFrame:
    """``candidate-NNN`` in order of the key rendered as text.

    Numbers come from sampled ranges of the whole key, so candidates that all
    share a registry host (or any other beginning) still spread over tasks.
    """
    order = F.concat_ws("|", *[F.col(c).cast("string") for c in CANDIDATE_KEY])
    numbered = number_rows(candidates.withColumn("_key", order), ["_key"], name="_number")
    return numbered.withColumn("candidate_id", F.format_string("candidate-%03d", F.col("_number"))).select(
        *candidates.columns, "candidate_id")


def candidate_members(snaps: DataFrame, numbered: DataFrame) -> DataFrame:
    """Member rows of each candidate (candidate_id, snapshot_id, name, state, size)."""
    keyed = with_candidate_key(snaps)
    return keyed.join(numbered.select(*CANDIDATE_KEY, "candidate_id"), list(CANDIDATE_KEY)).select(
        "candidate_id", "snapshot_id", "name", "state", "size")


def candidate_rollup(members: DataFrame, refs: DataFrame) -> DataFrame:
    """Per candidate: all_active, member count, fleets (sorted, distinct),
    shared_candidate (>1 fleet), potential_reclaimable_size =
    size * (n - 1) when every member has the same non-null size."""
    base = members.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("members"),
        F.bool_and(F.lower(F.coalesce("state", F.lit(""))) == "active").alias("all_active"),
        F.count("size").alias("_n_size"), F.min("size").alias("_lo"), F.max("size").alias("_hi"))
    fleets = (members.select("candidate_id", F.coalesce("name", F.lit("")).alias("_name")).distinct()
              .join(refs.select(F.col("snapshot").alias("_name"), "fleet").distinct(), "_name")
              .select("candidate_id", "fleet").distinct()
              .groupBy("candidate_id").agg(F.array_sort(F.collect_list("fleet")).alias("fleets")))
    j = base.join(fleets, "candidate_id", "left").withColumn(
        "fleets", F.coalesce("fleets", F.array().cast("array<string>")))
    same = (F.col("_n_size") == F.col("members")) & (F.col("_lo") == F.col("_hi"))
    return j.select("candidate_id", "members", "all_active", "fleets",
                    (F.size("fleets") > 1).alias("shared_candidate"),
                    F.when(same, F.col("_lo") * (F.col("members") - 1)).alias("potential_reclaimable_size"))


# ------------------------------------------------------------------ J12-J14 / A17


def unresolved_refs(refs: DataFrame, snaps: DataFrame) -> DataFrame:
    """Profile references naming no snapshot in the inventory."""
    present = snaps.filter(F.coalesce(F.col("name"), F.lit("")) != "").select(F.col("name").alias("snapshot"))
    return refs.join(present, "snapshot", "left_anti")


def references_of(snaps: DataFrame, refs: DataFrame) -> DataFrame:
    """The profile references (snapshot, fleet, profile, size_class as given)
    that name a snapshot of ``snaps``; rows, so no snapshot carries a list."""
    names = snaps.select(F.coalesce("name", F.lit("")).alias("snapshot")).distinct()
    return refs.join(names, "snapshot", "left_semi")


def full_snapshot_rows(snaps: DataFrame, status: DataFrame) -> DataFrame:
    """Every allow-listed snapshot field plus the reference status columns."""
    key = ["snapshot_id", "name"]
    one = status.groupBy(*[F.col(k).alias(f"_s_{k}") for k in key]).agg(
        F.first("references").alias("references"), F.first("reference_status").alias("reference_status"),
        F.first("duplicate_candidate").alias("duplicate_candidate"))
    on = [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in key]
    return snaps.join(one, on, "left").drop(*[f"_s_{k}" for k in key])


def unreferenced_snapshots(snaps: DataFrame, refs: DataFrame) -> DataFrame:
    """Snapshots whose name (null as '') no reference uses; colliding
    names without a reference are included."""
    r = refs.select(F.col("snapshot").alias("_ref")).distinct()
    return (snaps.join(r, F.coalesce(snaps["name"], F.lit("")) == r["_ref"], "left_anti")
            .select("snapshot_id", "name"))


def snapshot_reference_status(snaps: DataFrame, refs: DataFrame, collisions: DataFrame,
                              members: DataFrame) -> DataFrame:
    """Per snapshot: references count, status (ambiguous_name_collision >
    referenced > unreferenced) and its duplicate candidate id, if any."""
    ref_n = refs.groupBy(F.col("snapshot").alias("_rname")).agg(F.count(F.lit(1)).alias("references"))
    coll = collisions.select(F.col("snapshot_name").alias("_cname"), F.lit(True).alias("_collides"))
    # one candidate per (id, name): members that repeat a key, null keys among them, must not multiply snapshots
    mem = members.groupBy(F.col("snapshot_id").alias("_mid"), F.col("name").alias("_mname")).agg(
        F.min("candidate_id").alias("candidate_id"))
    key = F.coalesce(snaps["name"], F.lit(""))
    j = (snaps.join(ref_n, key == ref_n["_rname"], "left")
         .join(coll, snaps["name"] == coll["_cname"], "left")
         .join(mem, snaps["snapshot_id"].eqNullSafe(mem["_mid"]) & snaps["name"].eqNullSafe(mem["_mname"]), "left"))
    refs_n = F.coalesce("references", F.lit(0))
    status = (F.when(F.col("_collides"), "ambiguous_name_collision")
              .when(refs_n > 0, "referenced").otherwise("unreferenced"))
    return j.select("snapshot_id", "name", refs_n.alias("references"), status.alias("reference_status"),
                    F.col("candidate_id").alias("duplicate_candidate"))


def audit_summary(status: DataFrame, unresolved: DataFrame, unreferenced: DataFrame,
                  collisions: DataFrame, rollup: DataFrame) -> DataFrame:
    """The eight summary counts, one row (five small aggregates joined)."""
    s = status.agg(F.count(F.lit(1)).alias("snapshot_count"),
                   F.count_if(F.col("reference_status") == "referenced").alias("referenced_snapshot_count"),
                   F.count_if(F.col("reference_status") == "ambiguous_name_collision").alias("ambiguous_snapshot_count"))
    u = unreferenced.agg(F.count(F.lit(1)).alias("unreferenced_snapshot_count"))
    r = unresolved.select("snapshot").distinct().agg(F.count(F.lit(1)).alias("unresolved_profile_reference_count"))
    c = collisions.agg(F.count(F.lit(1)).alias("name_collision_count"))
    d = rollup.agg(F.count(F.lit(1)).alias("duplicate_candidate_count"),
                   F.count_if("shared_candidate").alias("shared_candidate_count"))
    return s.crossJoin(u).crossJoin(r).crossJoin(c).crossJoin(d)


def read_items_payload(payloads: DataFrame, json_col: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """A regions (or any inventory) response that is a list or an object
    with an ``items`` list; one row per item as JSON text, or an error row."""
    return read_snapshot_payload(payloads, json_col, keep)
