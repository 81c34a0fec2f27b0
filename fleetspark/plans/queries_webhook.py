"""Registered webhook queries (P17, P18, J2 on payloads, T-2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import register
from ..functions.webhook import _pads, hmac_sha256_hex, signature_ok
from ..operators import webhook as wh
from ..operators.labels import label_sets
from ..sources.fixtures import fixture, oracle_with

#: The label sets of ``fx_size_classes``, as a stream is given them.
CLASS_LABELS = [["self-hosted", "pool", "ci"], ["self-hosted", "pool", "ci", "large"], ["self-hosted", "pool", "ci", "xl"]]

SECRET = b"fixture-webhook-secret"
WAKE_INTERVAL = "1 hour"


def _sender_signature(body: Column, event_id: Column) -> Column:
    """What the sender put in X-Hub-Signature-256 (some rows tampered)."""
    b = F.encode(body, "UTF-8")
    good = hmac_sha256_hex(SECRET, b)
    return (F.when(event_id % 50 == 11, F.lit(None).cast("string"))
            .when(event_id % 10 == 3, F.concat(F.lit("sha1="), good))
            .when(event_id % 10 == 7, F.concat(F.lit("sha256="), hmac_sha256_hex(SECRET, F.concat(b, F.lit(b"x")))))
            .otherwise(F.concat(F.lit("sha256="), good)))


def requests_df(spark, sf):
    r = fixture(spark, sf, "fx_webhook_requests")
    return r.withColumn("signature", _sender_signature(F.col("body"), F.col("event_id")))


def _statuses(spark, sf):
    return wh.deliveries_status(requests_df(spark, sf), SECRET, label_sets(CLASS_LABELS))


_IPAD, _OPAD = _pads(SECRET)


def _hmac_sql(blob: str) -> str:
    return f"sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || {blob})))"


_REQ = f"""
req AS (SELECT *, CASE WHEN event_id % 50 = 11 THEN NULL
                     WHEN event_id % 10 = 3 THEN 'sha1=' || {_hmac_sql('encode(body)')}
                     WHEN event_id % 10 = 7 THEN 'sha256=' || {_hmac_sql("encode(body) || 'x'::BLOB")}
                     ELSE 'sha256=' || {_hmac_sql('encode(body)')} END AS signature FROM fx_webhook_requests),
sg AS (SELECT *, coalesce(starts_with(signature, 'sha256=') AND signature = 'sha256=' || {_hmac_sql('encode(body)')}, false)
              AS signature_ok,
              TRY_CAST(trim(content_length) AS BIGINT) AS n,
              coalesce(json_type(jb) = 'OBJECT', false) AS is_obj
       FROM (SELECT *, CASE WHEN json_valid(body) THEN body END AS jb FROM req) r0),
st AS (SELECT *, CASE WHEN path NOT IN ('/github', '/webhook', '/') THEN 404 WHEN n IS NULL THEN 400
                      WHEN n < 0 OR n > 1048576 THEN 413 WHEN NOT signature_ok THEN 401 WHEN event = 'ping' THEN 200
                      WHEN coalesce(event, '') <> 'workflow_job' THEN 202 WHEN NOT is_obj THEN 400 ELSE 202 END AS status
       FROM sg),
c AS (SELECT string_split(labels, ',') AS cl FROM fx_size_classes),
lb AS (SELECT *, CASE WHEN status = 202 AND is_obj AND json_type(jb, '$.workflow_job.labels') = 'ARRAY'
                      THEN list_filter(list_transform(json_extract(jb, '$.workflow_job.labels[*]'),
                             lambda e: CASE WHEN json_type(e) = 'VARCHAR' THEN json_extract_string(e, '$') END),
                             lambda s: s IS NOT NULL AND s <> '') END AS jl FROM st),
wk AS (SELECT event_id, ts, path, content_length, event, body, signature, signature_ok, status,
              status = 202 AND event = 'workflow_job' AND json_extract_string(jb, '$.action') = 'queued'
              AND json_type(jb, '$.workflow_job') = 'OBJECT'
              AND coalesce(len(jl) > 0 AND EXISTS (SELECT 1 FROM c WHERE list_has_all(jl, c.cl)), false) AS wake FROM lb)
"""
_VIEWS = ["fx_webhook_requests", "fx_size_classes"]

register("webhook_signature_ok", oracle_with(_VIEWS, f", {_REQ} SELECT event_id, signature_ok FROM sg"))(
    lambda spark, sf: requests_df(spark, sf).select(
        "event_id", signature_ok(SECRET, F.encode(F.col("body"), "UTF-8"), F.col("signature")).alias("signature_ok")))

register("classify_delivery", oracle_with(_VIEWS, f", {_REQ} SELECT event_id, status, wake FROM wk"))(
    lambda spark, sf: _statuses(spark, sf).select("event_id", "status", "wake"))

register("wake_coalesce", oracle_with(_VIEWS, f"""
, {_REQ} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, bool_or(wake) AS wake,
                count(*) FILTER (WHERE wake) AS matching FROM wk GROUP BY 1
"""))(lambda spark, sf: wh.wake_coalesce(_statuses(spark, sf), WAKE_INTERVAL))
