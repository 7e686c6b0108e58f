"""Expressions over keys, labels and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_key(key: Column, find: str = ".", put: str = "-") -> Column:
    """Rewrite source punctuation; literal replacement, not a pattern."""
    return F.replace(key, F.lit(find), F.lit(put))


def opening_value(historic: Column, current: Column, has_event: Column) -> Column:
    """Label before the first event, or today's label where nothing ever changed.

    A CASE rather than a COALESCE: an unrecorded historic value must stay NULL
    instead of being filled from the present.
    """
    return F.when(has_event, historic).otherwise(current)


def differs(a: Column, b: Column) -> Column:
    return a != b


def distinct_from(a: Column, b: Column) -> Column:
    """Null-safe inequality."""
    return ~a.eqNullSafe(b)


def present(value: Column) -> Column:
    return value.isNotNull()


def tagged(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), value)


def open_end_label(valid_to: Column) -> Column:
    return F.coalesce(valid_to.cast("string"), F.lit("current"))


def starts(value: Column, prefix: str) -> Column:
    """``startswith`` with NULL counted as no."""
    return F.coalesce(value.startswith(prefix), F.lit(False))


def polarity(gap: Column) -> Column:
    return F.when(gap >= 0, F.lit("overstates")).otherwise(F.lit("understates"))


def padded_identifier(raw: Column, width: int = 10) -> Column:
    """Numeric identifier as text with leading zeros; NULL stays NULL.

    Longer identifiers are kept whole (``lpad`` alone would cut them).
    """
    text = raw.try_cast("double").cast("bigint").cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def blank_to_null(raw: Column) -> Column:
    return F.when(F.trim(raw) != "", raw)
