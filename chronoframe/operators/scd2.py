"""Slowly changing dimension, type 2.

Two builders answer two questions: ``build_scd2`` reconstructs history from
today's state and a change log; ``snapshot_check`` tracks changes forward from
one run to the next.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions import (
    distinct_from,
    opening_value,
    overlaps_window,
    violates_lifetime,
    violation_kind,
)
from chronoframe.model import INITIAL, OPEN_START, IntegrityError, ReportingWindow
from chronoframe.operators.joins import scope_to
from chronoframe.operators.windows import first_per_key

KEY = "ticker"


def stage_events(log: DataFrame, universe: DataFrame) -> DataFrame:
    """Change events of analysable keys only."""
    return scope_to(log, universe, KEY)


def opening_state(universe: DataFrame, events: DataFrame) -> DataFrame:
    """Label of each key before its first event, valid from the opening sentinel."""
    first = first_per_key(
        events.select(KEY, "first_trading_day", "old_gics_sector", "old_gics_sub_industry"),
        KEY,
        "first_trading_day",
    )
    changed = F.col("first_trading_day").isNotNull()
    return universe.join(first, KEY, "left").select(
        KEY,
        opening_value(F.col("old_gics_sector"), F.col("current_gics_sector"), changed).alias("gics_sector"),
        opening_value(
            F.col("old_gics_sub_industry"), F.col("current_sub_industry"), changed
        ).alias("gics_sub_industry"),
        F.lit(OPEN_START).alias("valid_from"),
        F.lit(None).cast("date").alias("valid_to"),
        F.lit(True).alias("is_current"),
        F.lit(1).alias("version_number"),
        F.lit(INITIAL).alias("change_reason"),
    )


def replay(opening: DataFrame, events: DataFrame) -> DataFrame:
    """Apply staged events to opening rows: each event closes one row and opens the next.

    One ordered pass per key for any number of event dates. A version ends on
    the last old-label day stated by the *next* event, not on the day before it.
    """
    opened = events.select(
        KEY,
        F.col("new_gics_sector").alias("gics_sector"),
        F.col("new_gics_sub_industry").alias("gics_sub_industry"),
        F.col("first_trading_day").alias("valid_from"),
        F.col("effective_after_close").alias("_closes_previous"),
        F.col("change_type").alias("change_reason"),
    )
    started = opening.select(
        KEY,
        "gics_sector",
        "gics_sub_industry",
        "valid_from",
        F.lit(None).cast("date").alias("_closes_previous"),
        "change_reason",
    )
    return _number_versions(started.unionByName(opened))


def _number_versions(timeline: DataFrame) -> DataFrame:
    history = Window.partitionBy(KEY).orderBy("valid_from")
    closed = timeline.select(
        KEY,
        "gics_sector",
        "gics_sub_industry",
        "valid_from",
        F.lead("_closes_previous").over(history).alias("valid_to"),
        F.row_number().over(history).alias("version_number"),
        "change_reason",
    )
    return closed.select(
        KEY,
        "gics_sector",
        "gics_sub_industry",
        "valid_from",
        "valid_to",
        F.col("valid_to").isNull().alias("is_current"),
        "version_number",
        "change_reason",
    )


def build_scd2(universe: DataFrame, log: DataFrame) -> DataFrame:
    """Dimension from today's state and the change log, in a single shuffle on the key.

    Equal to ``replay(opening_state(u, e), e)`` with ``e = stage_events(log, u)``,
    but scoping, reconstruction of the opening row and replay all read the same
    ordered history of a key, so the three joins disappear. A key has at most
    one event per day, which bounds a window task by the calendar.
    """
    no_text, no_date = F.lit(None).cast("string"), F.lit(None).cast("date")
    today = universe.select(
        KEY,
        F.lit(True).alias("_opening"),
        F.lit(OPEN_START).alias("valid_from"),
        F.col("current_gics_sector").alias("_sector"),
        F.col("current_sub_industry").alias("_sub"),
        no_text.alias("_old_sector"),
        no_text.alias("_old_sub"),
        no_date.alias("_closes_previous"),
        F.lit(INITIAL).alias("change_reason"),
    )
    events = log.select(
        KEY,
        F.lit(False).alias("_opening"),
        F.col("first_trading_day").alias("valid_from"),
        F.col("new_gics_sector").alias("_sector"),
        F.col("new_gics_sub_industry").alias("_sub"),
        F.col("old_gics_sector").alias("_old_sector"),
        F.col("old_gics_sub_industry").alias("_old_sub"),
        F.col("effective_after_close").alias("_closes_previous"),
        F.col("change_type").alias("change_reason"),
    )
    history = Window.partitionBy(KEY).orderBy(F.desc("_opening"), "valid_from")
    following = F.lead(F.struct("_old_sector", "_old_sub", "_closes_previous")).over(history)
    walked = today.unionByName(events).select(
        "*",
        following.alias("_next"),
        F.row_number().over(history).alias("version_number"),
        F.first("_opening").over(history).alias("_in_universe"),
    )
    changed_later = F.col("_opening") & F.col("_next").isNotNull()
    built = walked.filter("_in_universe").select(
        KEY,
        opening_value(F.col("_next._old_sector"), F.col("_sector"), changed_later).alias("gics_sector"),
        opening_value(F.col("_next._old_sub"), F.col("_sub"), changed_later).alias("gics_sub_industry"),
        "valid_from",
        F.col("_next._closes_previous").alias("valid_to"),
        "version_number",
        "change_reason",
    )
    return built.select(
        KEY,
        "gics_sector",
        "gics_sub_industry",
        "valid_from",
        "valid_to",
        F.col("valid_to").isNull().alias("is_current"),
        "version_number",
        "change_reason",
    )


def with_sector_key(dim: DataFrame) -> DataFrame:
    """Surrogate key that is stable across rebuilds and needs no global order.

    It is a 64-bit hash of (key, version number); that pair stays the unique
    natural key and is what the library joins on.
    """
    return dim.select(F.xxhash64(KEY, "version_number").alias("sector_key"), "*")


def replay_imbalance(opening: DataFrame, events: DataFrame) -> DataFrame:
    """Event days on which rows closed and rows opened differ; empty is healthy.

    An event without an opening row of its key opens a row but closes none.
    """
    known = opening.select(KEY).distinct().withColumn("_known", F.lit(1))
    return (
        events.join(known, KEY, "left")
        .groupBy("first_trading_day")
        .agg(
            F.count("_known").alias("rows_closed"),
            F.count(F.lit(1)).alias("rows_opened"),
        )
        .filter(F.col("rows_closed") != F.col("rows_opened"))
    )


def checked_replay(opening: DataFrame, events: DataFrame) -> DataFrame:
    """``replay`` that refuses unbalanced event days."""
    first = replay_imbalance(opening, events).orderBy("first_trading_day").first()
    if first is not None:
        raise IntegrityError(
            f"on {first['first_trading_day']}: closed {first['rows_closed']} rows "
            f"but opened {first['rows_opened']}"
        )
    return replay(opening, events)


def broken_continuity(log: DataFrame) -> DataFrame:
    """Events whose old label is not the new label of the key's preceding event."""
    history = Window.partitionBy(KEY).orderBy("first_trading_day")
    return log.withColumn("expected_old_sector", F.lag("new_gics_sector").over(history)).filter(
        F.col("expected_old_sector").isNotNull()
        & distinct_from(F.col("expected_old_sector"), F.col("old_gics_sector"))
    )


def reconcile(dim: DataFrame, universe: DataFrame) -> DataFrame:
    """Keys whose replayed end state disagrees with today's state; empty is healthy."""
    current = dim.filter("is_current").select(
        KEY,
        F.col("gics_sector").alias("dimension_current_sector"),
        F.col("version_number").alias("versions_built"),
        F.col("valid_from").alias("current_version_from"),
    )
    arrival = universe.select(KEY, "security_name", F.col("current_gics_sector").alias("snapshot_sector"))
    return arrival.join(current, KEY).filter(
        distinct_from(F.col("dimension_current_sector"), F.col("snapshot_sector"))
    ).select(
        KEY,
        "security_name",
        "snapshot_sector",
        "dimension_current_sector",
        "versions_built",
        "current_version_from",
    )


def existence_violations(dim: DataFrame, registry: DataFrame, window: ReportingWindow) -> DataFrame:
    """Versions claiming a label on days when the label did not exist; empty is healthy."""
    lifetimes = registry.select(
        "gics_sector",
        F.col("existed_from").alias("sector_existed_from"),
        F.col("existed_to").alias("sector_existed_to"),
    )
    relevant = dim.filter(overlaps_window(F.col("valid_from"), F.col("valid_to"), window))
    claims = relevant.join(lifetimes, "gics_sector").filter(
        violates_lifetime(
            F.col("valid_from"),
            F.col("valid_to"),
            F.col("sector_existed_from"),
            F.col("sector_existed_to"),
            window,
        )
    )
    return claims.select(
        KEY,
        "gics_sector",
        "version_number",
        "valid_from",
        "valid_to",
        "sector_existed_from",
        "sector_existed_to",
        violation_kind(F.col("valid_from"), F.col("sector_existed_from"), window).alias("violation"),
    )


def snapshot_start(source: DataFrame, run_ts) -> DataFrame:
    """First run of the forward tracker: one open row per key."""
    return source.withColumns(
        {"valid_from": F.lit(run_ts), "valid_to": F.lit(None).cast(_type_of(run_ts))}
    )


def _type_of(run_ts) -> str:
    return "timestamp" if isinstance(run_ts, datetime) else "date"


def snapshot_check(
    tracked: DataFrame,
    source: DataFrame,
    run_ts,
    *,
    key: str = KEY,
    check_cols: Sequence[str] = ("current_gics_sector", "current_sub_industry"),
) -> DataFrame:
    """Next state of a forward-tracked dimension.

    A changed key is closed and reopened at ``run_ts``; a new key is opened; an
    unchanged key keeps its row; a key that left the source stays open.
    Closed rows pass through without taking part in the join.
    """
    is_open = F.col("valid_to").isNull()
    closed = tracked.filter(~is_open)
    held = tracked.filter(is_open).select(key, F.struct(*tracked.columns).alias("_held"))
    seen = source.select(key, F.struct(*source.columns).alias("_seen"))
    paired = held.join(seen, key, "full")

    held_state = F.struct(*[F.col(f"_held.{c}").alias(c) for c in check_cols])
    seen_state = F.struct(*[F.col(f"_seen.{c}").alias(c) for c in check_cols])
    known, arrived = F.col("_held").isNotNull(), F.col("_seen").isNotNull()
    changed = known & arrived & distinct_from(held_state, seen_state)

    stamp = F.lit(run_ts)
    end_type = tracked.schema["valid_to"].dataType
    reopened = F.struct(
        *[
            stamp.cast(end_type).alias(c)
            if c == "valid_from"
            else F.lit(None).cast(end_type).alias(c)
            if c == "valid_to"
            else F.col(f"_seen.{c}").alias(c)
            for c in tracked.columns
        ]
    )
    retired = F.struct(
        *[
            stamp.cast(end_type).alias(c) if c == "valid_to" else F.col(f"_held.{c}").alias(c)
            for c in tracked.columns
        ]
    )
    kept = F.struct(*[F.col(f"_held.{c}").alias(c) for c in tracked.columns])
    rows = (
        F.when(changed, F.array(retired, reopened))
        .when(~known, F.array(reopened))
        .otherwise(F.array(kept))
    )
    current = paired.select(F.explode(rows).alias("_row")).select("_row.*")
    return closed.unionByName(current)


def dim_stats(dim: DataFrame) -> DataFrame:
    """Row counts of a dimension: all versions, and second-or-later ones."""
    return dim.agg(
        F.count(F.lit(1)).alias("dimension_rows"),
        F.count_if(F.col("version_number") > 1).alias("later_versions"),
        F.count_if(F.col("is_current")).alias("current_rows"),
    )


def group_birth(dim: DataFrame, label: str = "gics_sector") -> DataFrame:
    """First day any version carries the label; the sentinel means 'always'."""
    return dim.groupBy(label).agg(F.min("valid_from").alias("sector_existed_from"))

