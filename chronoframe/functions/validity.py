"""Predicates over closed validity intervals (NULL end = still in force)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoframe.model import OPEN_END, ReportingWindow


def day_of(time: str | Column) -> Column:
    """The calendar day of a date or timestamp; intervals are closed and count whole days."""
    return (F.col(time) if isinstance(time, str) else time).cast("date")


def effective_end(valid_to: Column) -> Column:
    return F.coalesce(valid_to, F.lit(OPEN_END))


def covers(day: Column, valid_from: Column, valid_to: Column) -> Column:
    return (day >= valid_from) & (day <= effective_end(valid_to))


def overlaps_window(valid_from: Column, valid_to: Column, window: ReportingWindow) -> Column:
    return (valid_from <= F.lit(window.end)) & (effective_end(valid_to) >= F.lit(window.start))


def _claimed_early(valid_from: Column, existed_from: Column, window: ReportingWindow) -> Column:
    return F.greatest(valid_from, F.lit(window.start)) < existed_from


def violates_lifetime(
    valid_from: Column,
    valid_to: Column,
    existed_from: Column,
    existed_to: Column,
    window: ReportingWindow,
) -> Column:
    """The version claims its label outside the label's lifetime, within the window."""
    late = F.least(effective_end(valid_to), F.lit(window.end)) > existed_to
    return _claimed_early(valid_from, existed_from, window) | F.coalesce(late, F.lit(False))


# The two kinds stored in the violations table.
CLAIMED_EARLY = "claims sector before it existed"
CLAIMED_LATE = "claims sector after it was retired"


def violation_kind(valid_from: Column, existed_from: Column, window: ReportingWindow) -> Column:
    return F.when(
        _claimed_early(valid_from, existed_from, window),
        F.lit(CLAIMED_EARLY),
    ).otherwise(F.lit(CLAIMED_LATE))
