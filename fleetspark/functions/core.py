"""Scalar helpers shared by every operator (P1-P3, P10, P11, epoch maths)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite_nonnegative(c: ColumnOrName) -> Column:
    """The value when it is a finite number >= 0, else null.

    Input is DOUBLE (booleans and numeric text never reach a DOUBLE field
    when read with ``from_json``).  Spark orders NaN above +inf, so both
    bounds are explicit.
    """
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (x >= F.lit(0.0)) & (x < F.lit(float("inf"))), x)


def stage_secs(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Null if either mark is null, else round(max(end - start, 0), 3).

    ``greatest`` skips nulls in Spark, so the null guard is explicit.
    """
    s, e = col(start), col(end)
    return F.when(s.isNotNull() & e.isNotNull(), F.round(F.greatest(e - s, F.lit(0.0)), 3))


EPOCH_NTZ = "1970-01-01 00:00:00"


def epoch_to_ts(c: ColumnOrName) -> Column:
    """Epoch seconds (double) to TIMESTAMP_NTZ (UTC wall clock), zone-independent."""
    micros = F.round(col(c) * F.lit(1_000_000)).cast("long")
    return F.timestamp_add("MICROSECOND", micros, F.lit(EPOCH_NTZ).cast("timestamp_ntz"))


def ntz_epoch_secs(c: ColumnOrName) -> Column:
    """TIMESTAMP_NTZ (UTC wall clock) to epoch seconds, independent of session zone."""
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), col(c)) / F.lit(1e6)


def secs_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Seconds from ``start`` to ``end`` (both TIMESTAMP_NTZ), as double."""
    return F.timestamp_diff("MICROSECOND", col(start), col(end)) / F.lit(1e6)


def iso_millis(c: ColumnOrName) -> Column:
    """Epoch seconds -> ``yyyy-MM-ddTHH:mm:ss.SSSZ`` (UTC), null stays null."""
    return F.date_format(epoch_to_ts(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def ts_lit(text: str) -> Column:
    """A TIMESTAMP_NTZ literal (as-of instants are parameters, never the clock)."""
    return F.lit(text).cast("timestamp_ntz")


def sandbox_age_secs(created_at: ColumnOrName, as_of: str) -> Column:
    """P10: age of an ISO creation time at ``as_of`` (UTC), in seconds.

    Null when absent, unparsable, or without a zone offset (a naive time
    cannot be compared with an aware clock).  Accepts what the provider
    SDK's ISO text looks like: ``T`` or space separator, minutes or seconds
    with 1-6 fraction digits, and ``Z``, ``±HH:MM`` or ``±HHMM``.
    """
    text = F.regexp_replace(F.regexp_replace(col(created_at), "Z", "+00:00"),
                            r"^(\d{4}-\d{2}-\d{2}) ", "$1T")
    has_zone = text.rlike(r"[+-]\d{2}:?\d{2}$")
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in (
        "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XX",
        "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd'T'HH:mmXX")])
    # ``as_of`` is UTC wall-clock text; read it as an instant the same way.
    as_of_ts = F.try_to_timestamp(F.lit(as_of + "+00:00"), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    age = (F.unix_micros(as_of_ts) - F.unix_micros(parsed)) / F.lit(1e6)
    return F.when(has_zone, age)


def queue_wait_secs(created_at: ColumnOrName, as_of: str, text: bool = False) -> Column:
    """Seconds a job has waited at ``as_of``.

    ``created_at`` is a TIMESTAMP_NTZ (UTC wall clock) or, with ``text``,
    ``%Y-%m-%dT%H:%M:%SZ`` text as the API sends it; text that does not
    parse gives null (callers drop those jobs).  Single-letter fields accept
    unpadded numbers as ``strptime`` does.
    """
    c = col(created_at)
    if text:
        c = F.try_to_timestamp(c, F.lit("yyyy-M-d'T'H:m:s'Z'")).cast("timestamp_ntz")
    return secs_between(c, F.lit(as_of).cast("timestamp_ntz"))


def floor_minutes(secs: ColumnOrName) -> Column:
    """Whole minutes waited (``int(secs // 60)``)."""
    return F.floor(col(secs) / F.lit(60)).cast("long")
