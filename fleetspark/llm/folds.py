"""Which rows a model may learn from, by a checksum of the document id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null without an id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True for rows kept out of learning; a row without an id is never learnt from and not held out."""
    return F.coalesce(fold(doc_id, modulus) == remainder, F.lit(False))


def learnable(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True for rows that may be learnt from."""
    return F.coalesce(fold(doc_id, modulus) != remainder, F.lit(False))
