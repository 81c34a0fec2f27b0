"""Word rules that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab and the line breaks to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: The separators as characters, for ``translate``.
SPACES = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Number of words of a text as long; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def words(text: Column) -> Column:
    """The words of a text in order; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
