"""Shared data model: sentinels, enumerations, the reporting window, schemas."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Results depend on them.
OPEN_START = date(1900, 1, 1)
OPEN_END = date(9999, 12, 31)
RETURN_FLOOR = -0.9999

# Enumerations stored in the tables.
POINT_IN_TIME = "point_in_time"
NAIVE = "naive"
JOIN_BASES = (POINT_IN_TIME, NAIVE)

INITIAL = "initial"
RECLASSIFICATION = "reclassification"
SECTOR_RENAME = "sector_rename"
CHANGE_TYPES = (RECLASSIFICATION, SECTOR_RENAME)
CHANGE_REASONS = (INITIAL, RECLASSIFICATION, SECTOR_RENAME)

EXCLUSION_CLASSES = ("entity_discontinuity", "unverified_sector_history")


class SourceError(RuntimeError):
    """A source could not be read into the expected shape."""


class IntegrityError(RuntimeError):
    """A check that must hold returned violating rows."""


@dataclass(frozen=True)
class ReportingWindow:
    """The reporting period, both ends inclusive.

    It is carried as a value, not as a one-row table, so that date predicates
    become literals which Spark pushes into the Parquet scan.
    """

    start: date
    end: date

    def __post_init__(self) -> None:
        if not self.start < self.end:
            raise ValueError(f"window start {self.start} must precede end {self.end}")

    @classmethod
    def of(cls, start: str | date, end: str | date) -> ReportingWindow:
        as_date = lambda v: v if isinstance(v, date) else date.fromisoformat(v)
        return cls(as_date(start), as_date(end))

    def contains(self, day: Column) -> Column:
        return day.cast("date").between(F.lit(self.start), F.lit(self.end))

    @property
    def calendar_days(self) -> int:
        return (self.end - self.start).days + 1


def _struct(*fields: tuple[str, T.DataType, bool, str]) -> T.StructType:
    return T.StructType(
        [T.StructField(n, t, nullable, {"comment": doc}) for n, t, nullable, doc in fields]
    )


_S, _D, _F, _L, _I, _B = (
    T.StringType(),
    T.DateType(),
    T.DoubleType(),
    T.LongType(),
    T.IntegerType(),
    T.BooleanType(),
)

DAILY_PRICES = _struct(
    ("ticker", _S, False, "Entity key, taken from the file name"),
    ("trade_date", _D, False, "Observation day"),
    ("open_price", _F, True, "Opening price"),
    ("high_price", _F, True, "Day high"),
    ("low_price", _F, True, "Day low"),
    ("close_price", _F, True, "Closing price, the basis of every return"),
    ("volume", _L, True, "Units traded; gaps stay NULL"),
)

CURRENT_SNAPSHOT = _struct(
    ("ticker", _S, False, "Entity key as the snapshot writes it"),
    ("security_name", _S, True, "Display name"),
    ("gics_sector", _S, True, "Label in force today"),
    ("gics_sub_industry", _S, True, "Finer label in force today"),
    ("headquarters", _S, True, "Free text"),
    ("date_added", _D, True, "Lenient date; unparseable becomes NULL"),
    ("cik", _S, True, "Identifier, zero-padded to ten characters"),
    ("founded", _S, True, "Free-text year"),
)

SECTOR_HISTORY = _struct(
    ("ticker", _S, False, "Entity that changed"),
    ("company_name", _S, True, "Display name"),
    ("change_type", _S, False, "reclassification or sector_rename"),
    ("old_gics_sector", _S, False, "Label before the change"),
    ("new_gics_sector", _S, False, "Label after the change"),
    ("old_gics_sub_industry", _S, True, "Finer label before; NULL when not recorded"),
    ("new_gics_sub_industry", _S, True, "Finer label after; NULL when not recorded"),
    ("effective_after_close", _D, False, "Last day of the old label"),
    ("first_trading_day", _D, False, "First day of the new label"),
    ("source_id", _S, True, "Provenance"),
)

SECTOR_REGISTRY = _struct(
    ("gics_sector", _S, False, "Label"),
    ("existed_from", _D, False, "First day the label existed"),
    ("existed_to", _D, True, "Last day the label existed; NULL while alive"),
    ("source_id", _S, True, "Provenance"),
    ("notes", _S, True, "Free text"),
)

EXCLUDED_ENTITIES = _struct(
    ("ticker", _S, False, "Entity held out"),
    ("company_name", _S, True, "Display name"),
    ("exclusion_class", _S, False, "Kind of hold-out"),
    ("exclusion_reason", _S, False, "Why it is held out"),
)

MEMBERSHIP = _struct(
    ("ticker", _S, False, "Entity key; several intervals are possible"),
    ("start_date", _D, False, "First day of membership"),
    ("end_date", _D, True, "Last day of membership; NULL while a member"),
)

# Column documentation of the derived tables, attached on write.
TABLE_COMMENTS = {
    "silver.ticker_universe": "Entities with both observations and a current label",
    "silver.excluded_tickers": "Every entity left out, with the reason",
    "silver.stg_sector_events": "Change events scoped to the universe",
    "silver.dim_sector_scd": "One row per entity and label version, both interval ends inclusive",
    "silver.dim_reconciliation": "Entities whose replayed end state disagrees with the snapshot; empty is healthy",
    "silver.sector_existence_violations": "Versions claiming a label outside its lifetime; empty is healthy",
    "silver.fact_returns": "One row per entity and observed day; the first day has no return",
    "gold.fact_returns_pit": "Every return with the label of its day and the label of today",
    "gold.sector_daily_returns": "Equal-weighted mean return per basis, label and day",
    "gold.sector_cumulative_returns": "Daily means compounded into an index",
    "gold.anchor_metric": "One row per label: the cost of joining with today's label",
}

COLUMN_COMMENTS = {
    "valid_from": "First day in force, inclusive; 1900-01-01 on the opening version",
    "valid_to": "Last day in force, inclusive; NULL on the current version",
    "snapshot_ticker": "Key as written by the snapshot, so the mapping stays reversible",
    "prev_close": "Close of the previous observed day; NULL on the first",
    "daily_return": "close / prev_close - 1; NULL, never zero, on the first day",
    "comparison_start": "First day on which both bases have a series",
    "difference_pp": "Under the label of today minus under the label of the day, over the common period, percentage points",
    "naive_full_window_return": "What a report that ignores label lifetimes would publish",
}
