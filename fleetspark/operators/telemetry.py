"""Usage report over cycle records.

One hash aggregate per (group keys, snapshot) computes counts, outcome
pivot, duration coverage and nearest-rank p95, stage p95s and allocation
hours together, so the whole report is a single shuffle of a narrow
projection.  Coverage is all-or-nothing: a figure is published only when
every record of the cohort has a valid sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.core import finite_nonnegative
from ..schemas import STAGE_FIELDS
from ..session import stored

OUTCOMES = ("job", "idle", "failed", "unknown")


#: Value ranges to a factor of e in the nearest-rank search.
RANGES = 64


def nearest_rank_table(df: DataFrame, keys: list[str], fields: list[str], p: float,
                       suffix: str = "_p") -> DataFrame:
    """A3 for many fields at once, exact and skew-safe.

    Values are counted per (keys, field, value) map-side and shuffled by
    value.  The counts are added up per value range (``RANGES`` ranges to a
    factor of e, so some thousand per field whatever the data), a running
    total over the ranges finds the one that holds rank
    ``max(1, ceil(p * n))``, and only that range's values are ranked.  No
    window sees a whole group.  Output: keys + one ``<field><suffix>``
    column per field (null when the field has no value in the group).
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields])
    long = df.select(*keys, F.explode(pairs).alias("_x")).select(*keys, "_x.field", "_x.v").filter(F.col("v").isNotNull())
    return _ranked(long.groupBy(*keys, "field", "v").agg(F.count(F.lit(1)).alias("c")), keys, fields, p, suffix)


def _ranked(counts: DataFrame, keys: list[str], fields: list[str], p: float, suffix: str = "_p") -> DataFrame:
    """:func:`nearest_rank_table` of values that are counted already: keys, field, v, c."""
    counts = counts.withColumn("r", F.floor(F.asinh("v") * RANGES))
    group = Window.partitionBy(*keys, "field")
    ranges = counts.groupBy(*keys, "field", "r").agg(F.sum("c").alias("c")).select(
        "*", F.sum("c").over(group).alias("n"),
        F.sum("c").over(group.orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"))
    target = F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("n")))
    held = ranges.filter((F.col("upto") >= target) & (F.col("upto") - F.col("c") < target)).select(
        *[F.col(k).alias(f"_h_{k}") for k in keys], F.col("field").alias("_h_field"), F.col("r").alias("_h_r"),
        (target - F.col("upto") + F.col("c")).alias("need"))
    on = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in [*keys, "field", "r"]]
    inside = Window.partitionBy(*keys, "field").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    picked = (counts.join(held, on).withColumn("cum", F.sum("c").over(inside)).filter(F.col("cum") >= F.col("need"))
              .groupBy(*keys, "field").agg(F.min("v").alias("v")))
    out = picked.groupBy(*keys).pivot("field", list(fields)).agg(F.first("v"))
    return out.select(*keys, *[F.col(f).alias(f + suffix) for f in fields])


def _flat_resources(cycles: DataFrame) -> DataFrame:
    if "declared_resources" in cycles.columns and "cpu" not in cycles.columns:
        return cycles.select("*", F.col("declared_resources.cpu").alias("cpu"),
                             F.col("declared_resources.memory_gib").alias("memory_gib"),
                             F.col("declared_resources.disk_gib").alias("disk_gib"))
    return cycles


def _prepared(cycles: DataFrame, keys: list[str], all_rows: bool = False) -> DataFrame:
    """Narrow, validated projection: only what the aggregate reads; rows without a snapshot only on demand."""
    cycles = _flat_resources(cycles)
    snap = F.col("snapshot").cast("string")
    cols = [F.col(k) for k in keys] + [
        snap.alias("snapshot"),
        F.when(F.col("outcome").isin(*OUTCOMES), F.col("outcome")).otherwise("unknown").alias("outcome"),
        finite_nonnegative("total_secs").alias("v_total"),
    ]
    for f in STAGE_FIELDS:
        src = F.col(f) if f in cycles.columns else F.lit(None).cast("double")
        cols.append(finite_nonnegative(src).alias("v_" + f))
    alloc = finite_nonnegative("allocated_secs")
    cpu, ram, disk = (finite_nonnegative(c) for c in ("cpu", "memory_gib", "disk_gib"))
    counted = F.col("cleanup_status") == "deleted"
    full = counted & alloc.isNotNull() & cpu.isNotNull() & ram.isNotNull() & disk.isNotNull()
    zero = F.col("cleanup_status") == "create_not_attempted"
    cols += [
        (zero | F.coalesce(full, F.lit(False))).alias("alloc_counted"),
        # resource-seconds as DECIMAL so the sum does not depend on row order
        F.when(full, (cpu * alloc).cast("decimal(38,6)")).alias("cpu_s"),
        F.when(full, (ram * alloc).cast("decimal(38,6)")).alias("ram_s"),
        F.when(full, (disk * alloc).cast("decimal(38,6)")).alias("disk_s"),
    ]
    narrow = cycles.select(*cols)
    return narrow if all_rows else narrow.filter(F.col("snapshot").isNotNull() & (F.col("snapshot") != ""))


def _hours(c: str) -> Column:
    return F.round(F.coalesce(F.sum(c), F.lit(0).cast("decimal(38,6)")) / F.lit(3600), 2).cast("double")


def _counts(cycles: DataFrame, keys: list[str], prepared: DataFrame | None = None) -> DataFrame:
    """The plain aggregate behind A1, A2 and A4: no percentile, one pass."""
    p = _prepared(cycles, keys) if prepared is None else prepared
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    # whole microseconds, so that the mean depends neither on row order nor on binary fractions
    aggs += [F.count("v_total").alias("duration_count"),
             F.sum(F.round(F.col("v_total") * 1e6).cast("decimal(20,0)")).alias("_micros")]
    for f in STAGE_FIELDS:
        aggs += [F.count("v_" + f).alias("_n_" + f)]
    aggs += [F.count_if("alloc_counted").alias("alloc_count"),
             _hours("cpu_s").alias("_cpu"), _hours("ram_s").alias("_ram"), _hours("disk_s").alias("_disk")]
    return _with_average(p.groupBy(*keys, "snapshot").agg(*aggs))


def _with_average(totals: DataFrame) -> DataFrame:
    """Mean minutes in hundredths, half up."""
    return totals.withColumn("_avg", F.expr("(200 * _micros + 60000000 * duration_count) div (120000000 * duration_count)") / 100)


def _hour_columns() -> list[Column]:
    full = F.col("alloc_count") == F.col("n")
    return [F.when(full, F.col("_" + r)).alias(r + "_hours") for r in ("cpu", "ram", "disk")]


def usage_summary(cycles: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A1+A2+A4+A5 joined; one row per (keys, snapshot).

    Columns: n, job, idle, failed, unknown, duration_count, avg_minutes,
    p95_minutes, <stage>_p95 (secs), alloc_count, cpu_hours, ram_hours,
    disk_hours.  Figures are null unless coverage is complete.
    """
    keys = keys or []
    p = _prepared(cycles, keys)
    g = _counts(cycles, keys, p)
    value_cols = ["v_total"] + ["v_" + f for f in STAGE_FIELDS]
    return _published(g, nearest_rank_table(p, [*keys, "snapshot"], value_cols, 0.95, suffix=""), keys)


def _published(g: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """The summary's columns from totals and ranks; figures only at full coverage."""
    # join on renamed keys (null-safe: a group key such as instance may be null)
    gk = [*keys, "snapshot"]
    ranks = ranks.select(*[F.col(k).alias("_rk_" + k) for k in gk], F.col("v_total").alias("_p95"),
                         *[F.col("v_" + f).alias("_p_" + f) for f in STAGE_FIELDS])
    on = [F.col(k).eqNullSafe(F.col("_rk_" + k)) for k in gk]
    g = g.join(ranks, on, "left").drop(*["_rk_" + k for k in gk])
    full_dur = F.col("duration_count") == F.col("n")
    out = [F.col(k) for k in keys] + [
        "snapshot", "n", *OUTCOMES, "duration_count",
        F.when(full_dur, F.col("_avg")).alias("avg_minutes"),
        F.when(full_dur, F.round(F.col("_p95") / 60, 2)).alias("p95_minutes"),
    ]
    for f in STAGE_FIELDS:
        out.append(F.when(F.col("_n_" + f) == F.col("n"), F.round(F.col("_p_" + f), 2))
                   .alias(f.removesuffix("_secs") + "_p95"))
    out += ["alloc_count", *_hour_columns()]
    return g.select(*out)


_SUMS = ("cpu_s", "ram_s", "disk_s")
_VALUES = ("v_total", *("v_" + f for f in STAGE_FIELDS))


def usage_facts(cycles: DataFrame, keys: list[str]) -> DataFrame:
    """Everything the summary needs in one aggregate that can be merged.

    keys, snapshot, field, v, c and resource sums: how often each outcome
    (field ``outcome``'s name), each valid value of a duration or stage
    (``v`` its value), and each counted allocation (``alloc``) occurred.
    Facts of two sets of records are merged by :func:`merge_facts`.
    """
    return _tagged(_prepared(cycles, keys), keys).groupBy(*keys, "snapshot", "field", "v").agg(*_merged())


def _merged() -> list[Column]:
    return [F.sum("c").alias("c"), *[F.sum(s).cast("decimal(38,6)").alias(s) for s in _SUMS]]


def merge_facts(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of the union of the records behind several facts tables (united by name)."""
    return facts.groupBy(*keys, "snapshot", "field", "v").agg(*_merged())


def _tag(field: Column, v: Column | None = None, when: Column | None = None, sums: bool = False) -> Column:
    """One fact of a record as a struct; null where it does not hold."""
    null = F.lit(None)
    s = F.struct(field.alias("field"), (null if v is None else v).cast("double").alias("v"), F.lit(1).cast("long").alias("c"),
                 *[(F.col(x) if sums else null).cast("decimal(38,6)").alias(x) for x in _SUMS])
    return s if when is None else F.when(when, s)


def _fact_array() -> Column:
    facts = [_tag(F.col("outcome")), _tag(F.lit("alloc"), when=F.col("alloc_counted"), sums=True)]
    facts += [_tag(F.lit(f), F.col(f), F.col(f).isNotNull()) for f in _VALUES]
    return F.filter(F.array(*facts), lambda x: x.isNotNull())


def _tagged(prepared: DataFrame, keys: list[str]) -> DataFrame:
    return prepared.select(*keys, "snapshot", F.explode(_fact_array()).alias("_f")).select(*keys, "snapshot", "_f.*")


def summary_from_facts(facts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``usage_summary`` from :func:`usage_facts`; see there for the columns."""
    keys = keys or []
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0))
    is_value = lambda f: F.col("field") == f
    aggs = [count(F.col("field").isin(*OUTCOMES)).alias("n"), *[count(is_value(o)).alias(o) for o in OUTCOMES],
            count(is_value("v_total")).alias("duration_count"),
            F.sum(F.when(is_value("v_total"), F.round(F.col("v") * 1e6).cast("decimal(20,0)") * F.col("c"))).cast("decimal(38,0)").alias("_micros"),
            *[count(is_value("v_" + f)).alias("_n_" + f) for f in STAGE_FIELDS], count(is_value("alloc")).alias("alloc_count"),
            _hours("cpu_s").alias("_cpu"), _hours("ram_s").alias("_ram"), _hours("disk_s").alias("_disk")]
    totals = _with_average(facts.groupBy(*keys, "snapshot").agg(*aggs))
    ranks = _ranked(facts.where(F.col("field").isin(*_VALUES)).select(*keys, "snapshot", "field", "v", "c"),
                    [*keys, "snapshot"], list(_VALUES), 0.95, suffix="")
    return _published(totals, ranks, keys)


def usage_by_snapshot(cycles: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A1: record count and outcome pivot per non-empty snapshot."""
    keys = keys or []
    return _counts(cycles, keys).select(*keys, "snapshot", "n", *OUTCOMES)


def duration_summary(cycles: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A2+A3: avg and nearest-rank p95 minutes at full coverage, else coverage k/n."""
    keys = keys or []
    s = usage_summary(cycles, keys)
    return s.select(*keys, "snapshot", "n", "duration_count", "avg_minutes", "p95_minutes",
                    F.when(F.col("avg_minutes").isNull(),
                           F.format_string("coverage=%d/%d", "duration_count", "n")).alias("coverage"))


def allocation_hours(cycles: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A4: CPU/RAM/disk allocation-hours at full coverage."""
    keys = keys or []
    return _counts(cycles, keys).select(*keys, "snapshot", "n", "alloc_count", *_hour_columns())


def stage_p95(cycles: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A5: per-stage nearest-rank p95 seconds, present only at full coverage."""
    keys = keys or []
    stages = [f.removesuffix("_secs") + "_p95" for f in STAGE_FIELDS]
    return usage_summary(cycles, keys).select(*keys, "snapshot", "n", *stages)


def _fmt2(c: str) -> Column:
    return F.format_string("%.2f", F.col(c))


def usage_report_lines(summary: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The report text line for each row of ``usage_summary``."""
    keys = keys or []
    dur = F.when(F.col("avg_minutes").isNotNull(),
                 F.concat(F.lit("avg="), _fmt2("avg_minutes"), F.lit("m p95="), _fmt2("p95_minutes"), F.lit("m"))) \
        .otherwise(F.format_string("duration unavailable (coverage=%d/%d)", "duration_count", "n"))
    parts = [F.when(F.col(f.removesuffix("_secs") + "_p95").isNotNull(),
                    F.concat(F.lit(f.removesuffix("_secs") + "="), _fmt2(f.removesuffix("_secs") + "_p95"), F.lit("s")))
             for f in STAGE_FIELDS]
    stages = F.concat_ws("/", *parts)
    dur = F.when(stages != "", F.concat(dur, F.lit("; stages p95 "), stages)).otherwise(dur)
    alloc = F.when(F.col("cpu_hours").isNotNull(),
                   F.concat(F.lit("allocated="), _fmt2("cpu_hours"), F.lit(" CPU-h/"), _fmt2("ram_hours"),
                            F.lit(" GiB-h RAM/"), _fmt2("disk_hours"), F.lit(" GiB-h disk"))) \
        .otherwise(F.format_string("allocation unavailable (coverage=%d/%d)", "alloc_count", "n"))
    head = F.format_string("%s: n=%d job=%d idle=%d failed=%d unknown=%d ", "snapshot", "n", *OUTCOMES)
    return summary.select(*keys, "snapshot", F.concat(head, dur, F.lit("; "), alloc).alias("line"))


RUNNER_UP = "runner up:"


def legacy_spawn_class(line: Column) -> Column:
    """P20: on a ``runner up:`` line, the text between the first ``[`` and the
    next ``]`` (rest of the line when there is no ``]``); else null."""
    after_bracket = F.regexp_extract(line, r"(?s)^[^\[]*\[(.*)$", 1)
    return F.when(line.contains(RUNNER_UP) & line.contains("["),
                  F.substring_index(after_bracket, "]", 1))


def legacy_spawn_counts(journal: DataFrame, keys: list[str] | None = None, line_col: str = "line") -> DataFrame:
    """Spawn count per size class from legacy ``[class] runner up:`` lines."""
    keys = keys or []
    cls = legacy_spawn_class(F.col(line_col))
    return (journal.select(*keys, cls.alias("size_class")).filter(F.col("size_class").isNotNull())
            .groupBy(*keys, "size_class").agg(F.count(F.lit(1)).alias("spawns")))


def journal_facts(parsed_lines: DataFrame, line_col: str = "line") -> DataFrame:
    """:func:`usage_facts` per instance of all journal lines, with the fields
    ``spawn`` (``snapshot`` holds the size class) and ``valid`` (any record)."""
    line = F.col(line_col)
    is_spawn = line.contains(RUNNER_UP) & line.contains("[")
    own = [F.col("instance"), F.col("valid"), is_spawn.alias("_spawn"), legacy_spawn_class(line).alias("_class")]
    prepared = _prepared(parsed_lines.select("*", F.struct(*own).alias("_line")), ["_line"], all_rows=True)
    named = F.coalesce(F.col("snapshot"), F.lit("")) != ""
    facts = F.concat(
        F.when(F.col("_line.valid") & named, _fact_array()).otherwise(F.filter(F.array(_tag(F.lit("none"))), lambda x: F.lit(False))),
        F.filter(F.array(_tag(F.lit("valid"), when=F.col("_line.valid")), _tag(F.lit("spawn"), when=F.col("_line._spawn"))),
                 lambda x: x.isNotNull()))
    long = prepared.select("_line", "snapshot", F.explode(facts).alias("_f"))
    key = (F.when(F.col("_f.field") == "spawn", F.col("_line._class")).when(F.col("_f.field") != "valid", F.col("snapshot")))
    return long.select("_line.instance", key.alias("snapshot"), "_f.*").groupBy("instance", "snapshot", "field", "v").agg(*_merged())


def usage_report(instances: DataFrame, parsed_lines: DataFrame, line_col: str = "line") -> DataFrame:
    """The per-instance report as (instance, line_no, text).

    ``instances`` has (instance, unit[, journal_exit]); an instance without
    a unit is skipped, and one whose journal read failed (non-zero
    ``journal_exit``) gets the single line ``journal unavailable (exit N)``.  ``parsed_lines`` is every journal line with its parse result
    (``parse_cycle_telemetry(..., keep_all=True)``).  With structured
    records an instance gets a header line (all parsed records, runner-up
    line count) and one indented line per snapshot; otherwise one legacy
    line with the spawn counts per class, or ``no spawns``.

    The journal is parsed once: every line becomes tagged facts (outcome,
    values and allocation of a valid record, its spawn class), one aggregate
    adds them up, and its result, a row per distinct value, is stored; all
    figures come from that.
    """
    exit_col = F.col("journal_exit") if "journal_exit" in instances.columns else F.lit(0)
    inst_all = instances.filter(F.coalesce(F.col("unit"), F.lit("")) != "").select("instance", exit_col.alias("_exit"))
    failed = inst_all.filter(F.coalesce(F.col("_exit"), F.lit(0)) != 0).select(
        "instance", F.lit(0).cast("long").alias("line_no"),
        F.format_string("%s: journal unavailable (exit %d)", "instance", "_exit").alias("text"))
    inst = inst_all.filter(F.coalesce(F.col("_exit"), F.lit(0)) == 0).select("instance").distinct()
    facts = stored(parsed_lines.sparkSession, journal_facts(parsed_lines, line_col), "usage-facts")
    totals = facts.groupBy("instance").agg(F.sum(F.when(F.col("field") == "spawn", F.col("c"))).alias("runner_up"),
                                           F.sum(F.when(F.col("field") == "valid", F.col("c"))).alias("completions"))
    per_cls = facts.filter("field = 'spawn'").select("instance", F.col("snapshot").alias("size_class"), F.col("c").alias("spawns"))
    legacy = (per_cls.filter(F.col("size_class").isNotNull()).groupBy("instance")
              .agg(F.array_sort(F.collect_list(F.struct("size_class", "spawns"))).alias("c"))
              .select("instance", F.concat_ws(", ", F.transform(
                  "c", lambda x: F.concat(x["spawns"].cast("string"), F.lit(" "), x["size_class"]))).alias("legacy")))
    records = facts.filter(~F.col("field").isin("spawn", "valid"))
    lines = usage_report_lines(summary_from_facts(records, ["instance"]), ["instance"])
    w = Window.partitionBy("instance").orderBy("snapshot")
    snap_lines = lines.select("instance", F.row_number().over(w).cast("long").alias("line_no"),
                              F.concat(F.lit("  "), F.col("line")).alias("text"))
    with_summary = snap_lines.select("instance").distinct().withColumn("structured", F.lit(True))
    base = inst.join(with_summary, "instance", "left").join(totals, "instance", "left").join(legacy, "instance", "left")
    header = base.select(
        "instance", F.lit(0).cast("long").alias("line_no"),
        F.when(F.col("structured"),
               F.format_string("%s: structured completions=%d; runner-up lines=%d; window may span the telemetry rollout",
                               "instance", F.coalesce("completions", F.lit(0)), F.coalesce("runner_up", F.lit(0))))
        .otherwise(F.concat(F.col("instance"), F.lit(": legacy window; "),
                            F.coalesce(F.nullif(F.col("legacy"), F.lit("")), F.lit("no spawns")))).alias("text"))
    body = snap_lines.join(inst, "instance", "left_semi")
    return header.unionByName(body).unionByName(failed)
