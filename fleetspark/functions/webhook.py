"""Webhook request checks (P17, P18) as native column expressions.

HMAC-SHA256 is built from ``sha2`` and ``unhex``: with a fixed secret the
inner and outer pads are constants, so the signature check stays inside
whole-stage codegen (no UDF).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import MAX_BODY_BYTES, SIGNATURE_PREFIX, WEBHOOK_PATHS  # noqa: F401

_BLOCK = 64


def _pads(secret: bytes) -> tuple[str, str]:
    key = hashlib.sha256(secret).digest() if len(secret) > _BLOCK else secret
    key = key.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_sha256_hex(secret: bytes, body: Column) -> Column:
    """Hex HMAC-SHA256 of binary ``body`` under ``secret``."""
    ipad, opad = _pads(secret)
    inner = F.unhex(F.sha2(F.concat(F.unhex(F.lit(ipad)), body), 256))
    return F.sha2(F.concat(F.unhex(F.lit(opad)), inner), 256)


def signature_ok(secret: bytes, body: Column, header: Column) -> Column:
    """Header is ``sha256=<hex digest>`` of the body; null or any other
    prefix is false."""
    expected = F.concat(F.lit(SIGNATURE_PREFIX), hmac_sha256_hex(secret, body))
    return F.coalesce(header.startswith(SIGNATURE_PREFIX) & (header == expected), F.lit(False))


def classify_delivery(path: Column, content_length: Column, sig_ok: Column, event: Column,
                      body_is_object: Column) -> Column:
    """HTTP status, first failing rule wins (404, 400, 413, 401, 200
    ping, 202 other event, 400 bad JSON, else 202)."""
    n = F.trim(content_length).try_cast("long")
    return (F.when(~path.isin(*WEBHOOK_PATHS), 404)
            .when(n.isNull(), 400)
            .when((n < 0) | (n > MAX_BODY_BYTES), 413)
            .when(~sig_ok, 401)
            .when(event == "ping", 200)
            .when(F.coalesce(event, F.lit("")) != "workflow_job", 202)
            .when(~body_is_object, 400)
            .otherwise(202))
