"""Webhook deliveries: verify, classify, match and coalesce (P17, P18, J2, T-2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.webhook import classify_delivery, signature_ok
from .labels import clean_labels, covers_some_class


def deliveries_status(requests: DataFrame, secret: bytes, label_sets: Column) -> DataFrame:
    """Per request: status, signature_ok and ``wake`` (status 202,
    workflow_job event, action queued, workflow_job an object whose string
    labels cover some class).  ``requests`` has path, content_length,
    signature, event, body (string); ``label_sets`` is
    ``labels.label_sets([[...], ...])``.  Stateless: works on a batch or
    a stream, one pass, no join.

    The body is parsed once (behind a generator so later expressions reuse
    it); strictness (exactly one JSON value) uses the wrapped-array check.
    """
    body = F.col("body")
    parsed = requests.select("*", F.inline(F.array(F.struct(
        F.try_parse_json(body).alias("_v"),
        F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))).alias("_n"),
        signature_ok(secret, F.encode(body, "UTF-8"), F.col("signature")).alias("signature_ok")))))
    v = F.col("_v")
    wrapped_ok = F.from_json(F.concat(F.lit('{"r":'), body, F.lit("}")), "r STRING")["r"].isNotNull()
    is_obj = (F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
              & (F.coalesce(F.col("_n"), F.lit(0)) == 1) & wrapped_ok)
    job = F.variant_get(v, "$.workflow_job", "variant")
    labels_v = F.variant_get(job, "$.labels", "variant")
    labels = F.when(F.schema_of_variant(labels_v).startswith("ARRAY"), clean_labels(F.transform(
        F.filter(F.variant_get(labels_v, "$", "array<variant>"), lambda e: F.schema_of_variant(e) == "STRING"),
        lambda e: F.variant_get(e, "$", "string"))))
    status = classify_delivery(F.col("path"), F.col("content_length"), F.col("signature_ok"), F.col("event"), is_obj)
    wake = ((status == 202) & (F.col("event") == "workflow_job") & (F.variant_get(v, "$.action", "string") == "queued")
            & F.coalesce(F.schema_of_variant(job).startswith("OBJECT"), F.lit(False))
            & covers_some_class(labels, label_sets))
    return parsed.select(*requests.columns, "signature_ok", status.alias("status"),
                         F.coalesce(wake, F.lit(False)).alias("wake"))


def wake_coalesce(deliveries: DataFrame, interval: str, key: list[str] | None = None) -> DataFrame:
    """T-2: one wake per poll interval: tumbling windows with ``bool_or``;
    the number of matching deliveries is kept as an extra column."""
    key = key or []
    return (deliveries.groupBy(*key, F.window("ts", interval).alias("w"))
            .agg(F.bool_or("wake").alias("wake"), F.count_if("wake").alias("matching"))
            .select(*key, F.col("w.start").alias("window_start"), "wake", "matching"))
