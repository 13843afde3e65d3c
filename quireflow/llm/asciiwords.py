"""Words of ASCII letters, digits and all characters beyond ASCII, in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows up to which a table made from test items or templates is broadcast.
BROADCAST_ROWS = 1_000_000


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else; the plain function serves where all is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def raw_words(text: Column) -> Column:
    """Words in their own case; the last may be empty. A null has none but that."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "^" + _BETWEEN, ""), _BETWEEN)


def word_count(words: Column) -> Column:
    return (F.size(words) - F.when(F.element_at(words, -1) == "", 1).otherwise(0)).cast("long")


def phrase(words: Column, start: Column, length: Column) -> Column:
    """Lower-cased words from `start` (0 is the first), joined by a space; null before the first word."""
    return F.when(start >= 0, ascii_lower(F.array_join(F.slice(words, F.greatest(start, F.lit(0)) + 1, length), " ")))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast, if so few rows are known to be in it; else Spark joins by shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
