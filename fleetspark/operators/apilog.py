"""API request-log maths.

Per-fleet ordered windows over the request log: the backoff sequence is a
running count inside reset-delimited segments; pacing compares each start
with the previous start and the running maximum cooldown end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import ntz_epoch_secs
from .scan import Running, running
from ..fixed import BACKOFF_INITIAL_SECS, BACKOFF_MAX_SECS, RATE_LIMITED  # noqa: F401

SCAN_BUCKET_SECS = 3600  # time slice of the running scans (see operators/scan.py)


def _hour_bucket(ts: str = "ts") -> Column:
    return F.floor(ntz_epoch_secs(ts) / SCAN_BUCKET_SECS)


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


# Zone names of mail dates, in hours from UTC; other names count as UTC.
_ZONES = {"AST": -4, "ADT": -3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_C_DATE = r"^(?:[A-Za-z]+,?\s+)?([A-Za-z]{3,9})\s+([0-9]{1,2})\s+([0-9]{1,2}:[0-9]{2}:[0-9]{2})\s+([0-9]{4})\z"
_MAIL_DATE = (r"^(?:[A-Za-z]+,?\s*)?([0-9]{1,2})[\s-]+([A-Za-z]{3,9})[\s-]+([0-9]{2}|[0-9]{4})\s+"
              r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?(?:\s+([A-Za-z]+|[+-][0-9]{4})(?:\s[\s\S]*)?)?\z")


def _http_date_epoch(text: Column) -> Column:
    """A date header in any mail layout to epoch seconds, null for anything else.

    ``Wed, 31 Jan 2024 00:00:00 GMT``; without the weekday or the seconds;
    with a zone name or an offset (none: UTC); with dashes and a two-digit
    year (69 to 99 are of the last century); and the C library's order
    ``Wed Jan 31 00:00:00 2024``.  The weekday is not compared with the day,
    what follows the zone is not read.
    """
    body = F.regexp_replace(F.trim(text), _C_DATE, "$2 $1 $4 $3")
    parts = F.split(F.regexp_replace(body, _MAIL_DATE, "$1,$2,$3,$4,$5,$6,$7"), ",")
    month_at = F.create_map(*[x for i, m in enumerate(_MONTHS) for x in (F.lit(m), F.lit(i + 1))])
    zone_at = F.create_map(*[x for z, h in _ZONES.items() for x in (F.lit(z), F.lit(h * 3600))])

    def epoch(p: Column) -> Column:
        number = lambda i: p[i].try_cast("int")
        year = F.when(F.length(p[2]) == 4, number(2)).otherwise(number(2) + F.when(number(2) > 68, 1900).otherwise(2000))
        second = F.coalesce(number(5), F.lit(0))
        at = F.try_make_timestamp(year, F.try_element_at(month_at, F.lower(F.left(p[1], F.lit(3)))), number(0), number(3), number(4),
                                  second.cast("decimal(16,6)"), F.lit("UTC"))
        offset = F.when(p[6].rlike("^[+-]"), F.when(p[6].startswith("-"), -1).otherwise(1) * (
            F.substring(p[6], 2, 2).try_cast("int") * 3600 + F.substring(p[6], 4, 2).try_cast("int") * 60))
        zone = F.coalesce(offset, F.try_element_at(zone_at, F.upper(p[6])), F.lit(0))
        return F.when((second < 60) & (F.size(p) == 7), F.unix_micros(at) / F.lit(1e6) - zone)

    # the parts stand behind a transform, so that they are matched once
    return F.transform(F.array(F.when(body.rlike(_MAIL_DATE), parts)), epoch)[0]


def directed_delay(retry_after: Column, reset: Column, remaining: Column, now_epoch: Column) -> Column:
    """Server-directed delay as struct(delay_secs, source), or null.

    Retry-After as seconds (or an HTTP date minus now) when finite and >= 0
    gives 'retry-after'; otherwise, when Remaining is exactly '0', Reset
    minus now when finite and > 0 gives 'rate-limit-reset'.
    """
    ra = F.trim(retry_after)
    ra_secs = F.coalesce(ra.try_cast("double"), _http_date_epoch(ra) - now_epoch)
    reset_secs = F.trim(reset).try_cast("double") - now_epoch
    use_ra = retry_after.isNotNull() & _finite(ra_secs) & (ra_secs >= 0)
    use_reset = (reset.isNotNull() & (F.trim(remaining) == "0") & _finite(reset_secs) & (reset_secs > 0))
    return (F.when(use_ra, F.struct(ra_secs.alias("delay_secs"), F.lit("retry-after").alias("source")))
            .when(use_reset, F.struct(reset_secs.alias("delay_secs"), F.lit("rate-limit-reset").alias("source"))))


def backoff_sequence(log: DataFrame, key: str = "fleet", order: tuple[str, ...] = ("ts", "event_id"),
                     directed: Column | None = None) -> DataFrame:
    """Cooldown per rate-limited response.

    A 403/429 without a directed delay is the k-th undirected failure since
    the last reset and waits ``min(60 * 2^(k-1), 900)``; a directed one
    waits the server's delay and does not advance k.  A reset happens only
    at a completed tick (``tick_completed``) with no 403/429 inside that
    tick.  Output adds ``cooldown_secs``, ``cooldown_source`` and
    ``backoff_reset``.

    Two time-sliced running scans (``scan.running``) replace the
    per-fleet window, so a fleet with most of the log still spreads over
    the cluster: scan 1 numbers ticks and counts undirected failures (U);
    the tick error counts are a grouped aggregate; scan 2 carries U at the
    last reset, and k = U - U_at_last_reset.
    """
    limited = F.col("status").isin(*RATE_LIMITED)
    d = directed if directed is not None else F.lit(None).cast("struct<delay_secs:double,source:string>")
    x = log.withColumn("_limited", limited).withColumn("_directed", d)
    undirected = F.col("_limited") & F.col("_directed").isNull()
    x = running(x, [key], list(order), [
        Running("_tick", F.col("tick_completed").cast("long"), "sum", inclusive=False),
        Running("_u", undirected.cast("long"), "sum")], _hour_bucket())
    errors = x.groupBy(key, "_tick").agg(F.sum(F.col("_limited").cast("long")).alias("_tick_errors"))
    x = x.join(errors, [key, "_tick"]).withColumn(
        "_reset", F.coalesce(F.col("tick_completed"), F.lit(False)) & (F.col("_tick_errors") == 0))
    x = running(x, [key], list(order), [
        Running("_u_at_reset", F.when(F.col("_reset"), F.col("_u")), "max", inclusive=False)], _hour_bucket())
    k = F.col("_u") - F.coalesce(F.col("_u_at_reset"), F.lit(0))
    fallback = F.least(F.lit(float(BACKOFF_INITIAL_SECS)) * F.pow(F.lit(2.0), k - 1), F.lit(float(BACKOFF_MAX_SECS)))
    secs = F.when(~F.col("_limited"), F.lit(None).cast("double")).when(
        F.col("_directed").isNotNull(), F.col("_directed.delay_secs")).otherwise(fallback)
    source = F.when(~F.col("_limited"), F.lit(None).cast("string")).when(
        F.col("_directed").isNotNull(), F.col("_directed.source")).otherwise(F.lit("exponential-fallback"))
    return x.select(*log.columns, secs.alias("cooldown_secs"), source.alias("cooldown_source"),
                    F.col("_reset").alias("backoff_reset"))


def pacing_gaps(log: DataFrame, spacing_secs: float, key: str = "fleet",
                order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Start-to-start gap per fleet and whether a start came early.

    The earliest allowed start is the later of the previous start plus the
    configured spacing and the running maximum cooldown end of earlier
    rate-limited responses.  Needs ``cooldown_secs`` (from W6).  Starts are
    in time order, so the previous start is the running maximum of earlier
    starts: both are exclusive running maxima from one time-sliced scan.
    """
    start = ntz_epoch_secs("ts")
    x = log.withColumn("_start", start).withColumn(
        "_cool_end", F.when(F.col("cooldown_secs").isNotNull(), start + F.col("cooldown_secs")))
    x = running(x, [key], list(order), [Running("_prev", F.col("_start"), "max", inclusive=False),
                                        Running("_cool", F.col("_cool_end"), "max", inclusive=False)],
                _hour_bucket())
    allowed = F.greatest(F.col("_prev") + F.lit(float(spacing_secs)), F.col("_cool"))
    allowed = F.when(F.col("_prev").isNotNull(), allowed)
    return x.select(*log.columns, (F.col("_start") - F.col("_prev")).alias("gap_secs"), allowed.alias("allowed_from"),
                    F.coalesce(F.col("_start") < allowed, F.lit(False)).alias("early"))


def pacing_gate(log: DataFrame, spacing_secs: float, key: str = "fleet",
                order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """W7, exact gate form: the earliest allowed start of each request is the
    gate's ``next_request_at`` after the previous request.

    After a success the gate is ``start + spacing``; after a rate-limited
    response it is the maximum of its previous value, ``start + spacing``
    and ``start + cooldown``.  So after row i it equals ``start_i + spacing``
    raised, for a failure, to the largest cooldown end since the last
    success.  Computed with time-sliced running scans (segment number =
    successes before the row; largest cooldown end within the segment; the
    previous row's gate as the running maximum of (order, gate)).  Needs
    ``cooldown_secs`` (from W6).
    """
    start = ntz_epoch_secs("ts")
    ok = ~F.col("status").isin(*RATE_LIMITED)
    x = log.withColumn("_start", start).withColumn(
        "_cool_end", F.when(F.col("cooldown_secs").isNotNull(), start + F.col("cooldown_secs")))
    x = running(x, [key], list(order), [Running("_seg", ok.cast("long"), "sum", inclusive=False),
                                        Running("_prev", F.col("_start"), "max", inclusive=False)], _hour_bucket())
    x = running(x, [key, "_seg"], list(order), [Running("_cmax", F.col("_cool_end"), "max")], _hour_bucket())
    spaced = F.col("_start") + F.lit(float(spacing_secs))
    gate = F.when(ok, spaced).otherwise(F.greatest(spaced, F.col("_cmax")))
    x = x.withColumn("_gate", F.struct(*[F.col(o) for o in order], gate.alias("g")))
    x = running(x, [key], list(order), [Running("_prev_gate", F.col("_gate"), "max", inclusive=False)], _hour_bucket())
    allowed = F.col("_prev_gate.g")
    return x.select(*log.columns, (F.col("_start") - F.col("_prev")).alias("gap_secs"), allowed.alias("allowed_from"),
                    F.coalesce(F.col("_start") < allowed, F.lit(False)).alias("early"))
