"""Journal text in, cycle records out.

``scan_journal`` bounds lines by time; ``parse_cycle_telemetry`` keeps the
exact v1 contract; ``cycle_record_lines`` renders records the way the
producer logs them so the pair round-trips.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import ts_lit
from ..schemas import CYCLE_RECORD_JSON, TELEMETRY_EVENT, TELEMETRY_SCHEMA_VERSION
from ..fixed import TELEMETRY_PREFIX  # noqa: F401


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Raw journal export (``journalctl -o cat``), one row per line, with the file it came from."""
    return spark.read.text(path).select(F.col("value").alias("line"),
                                        F.input_file_name().alias("source_file"))


def scan_journal(journal: DataFrame, as_of: str, since_secs: int, ts_col: str = "ts") -> DataFrame:
    """Lines inside ``[as_of - since, as_of]``.  A plain range predicate,
    so Parquet row-group statistics prune the scan."""
    ts = F.col(ts_col)
    lo = F.timestamp_add("SECOND", F.lit(-int(since_secs)), ts_lit(as_of))
    return journal.filter((ts >= lo) & (ts <= ts_lit(as_of)))


def parse_cycle_telemetry(lines: DataFrame, line_col: str = "line", keep: list[str] | None = None,
                          keep_all: bool = False) -> DataFrame:
    """Cycle records from journal lines.

    Takes the text after the *first* marker, parses it as one JSON object
    and keeps it only when ``event`` and ``schema_version`` match the v1
    contract.  Malformed lines are dropped, never raised.

    ``from_json`` ignores text after the first value, so the payload is
    parsed wrapped in an object (``{"r": payload}``: trailing text becomes
    a syntax error) and, to reject a second top-level value smuggled in as
    an extra wrapper key, also wrapped in an array that must hold exactly
    one element.  Two parses per line, both JVM-side.

    With ``keep_all`` every line is returned with a ``valid`` flag (record
    fields null when invalid) so callers can count lines and records in
    the same pass.
    """
    line = F.col(line_col)
    pos = F.instr(line, TELEMETRY_PREFIX)
    payload = F.expr(f"substr({line_col}, instr({line_col}, '{TELEMETRY_PREFIX}') + {len(TELEMETRY_PREFIX)})")
    wrapped = F.from_json(F.concat(F.lit('{"r":'), payload, F.lit("}")),
                          T.StructType([T.StructField("r", CYCLE_RECORD_JSON)]))
    n_items = F.json_array_length(F.concat(F.lit("["), payload, F.lit("]")))
    keep = [c for c in (keep if keep is not None else lines.columns) if c != line_col]
    # The parse runs inside ``inline`` (a Generate): filters on the parsed
    # fields cannot be pushed below it, so the JSON is parsed once per line
    # instead of once per predicate that mentions it.
    if keep_all:
        has = pos > 0
        parsed = lines.select(*keep, line.alias(line_col), F.inline(F.array(F.struct(
            F.when(has, wrapped["r"]).alias("_r"), F.when(has, n_items).alias("_a")))))
    else:
        candidates = lines.filter(pos > 0)  # cheap substring test before any JSON work
        parsed = candidates.select(*keep, F.inline(F.array(F.struct(wrapped["r"].alias("_r"), n_items.alias("_a")))))
    ok = F.coalesce(F.col("_r").isNotNull() & (F.col("_r.event") == TELEMETRY_EVENT)
                    & (F.col("_r.schema_version") == float(TELEMETRY_SCHEMA_VERSION))
                    & (F.coalesce(F.col("_a"), F.lit(0)) == 1), F.lit(False))
    snap = F.col("_r.snapshot")
    fields = [F.when(F.schema_of_variant(snap) == "STRING", F.variant_get(snap, "$", "string")).alias(f.name)
              if f.name == "snapshot" else F.col(f"_r.{f.name}").alias(f.name) for f in CYCLE_RECORD_JSON.fields]
    if keep_all:
        return parsed.select(*keep, line_col, ok.alias("valid"), *fields)
    return parsed.filter(ok).select(*keep, *fields)


def cycle_record_lines(records: DataFrame, key_cols: list[str] | None = None) -> DataFrame:
    """One ``cycle_telemetry {json}`` line per record.

    Keys are written in sorted order and nulls are kept (``null``), like the
    producer's ``json.dumps(sort_keys=True)``.
    """
    key_cols = key_cols or []
    fields = sorted(c for c in records.columns if c not in key_cols)
    body = F.to_json(F.struct(*[F.col(c) for c in fields]), {"ignoreNullFields": "false"})
    return records.select(*key_cols, F.concat(F.lit(TELEMETRY_PREFIX), body).alias("line"))


def write_cycle_records(records: DataFrame, path: str, key_cols: list[str] | None = None) -> None:
    """Write S8 lines as text files (one line per record)."""
    cycle_record_lines(records, key_cols).select("line").write.mode("overwrite").text(path)
