"""Temporal joins.

No side is broadcast by hint: Spark broadcasts a side only when its measured
size is below ``spark.sql.autoBroadcastJoinThreshold``, at planning or, through
adaptive execution, at run time. Above it the join is a sort-merge join on the
key with the date range as residual condition, and adaptive execution splits
skewed fact partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions import covers, day_of, differs, effective_end
from chronoframe.model import OPEN_END, OPEN_START
from chronoframe.operators.shaping import distinct_keys, require, union_all
from chronoframe.session import stored

STRATEGIES = ("range", "sliced", "asof", "prefix")


def pit_join(
    facts: DataFrame,
    dim: DataFrame,
    *,
    key: str = "ticker",
    time: str = "trade_date",
    attributes: Sequence[str] = ("gics_sector",),
    how: str = "inner",
    strategy: str = "range",
    slice_unit: str = "year",
    days: tuple[date, date] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Join each fact to the version of its key in force on the fact's day.

    Strategies, all exact on a dimension without overlaps:

    * ``range``  – equi join on the key, date range as residual condition. Work
      per fact is the number of versions of its key.
    * ``sliced`` – versions are repeated once per calendar slice they touch and
      the slice joins the equi key. Work per fact is the number of versions in
      one slice, and a hot key is spread over its slices. For long histories.
    * ``asof``   – versions and facts are merged in one ordered pass per key and
      slice. Linear in both, whatever the number of versions, but an overlap is
      resolved silently instead of showing up twice.

    * ``prefix`` – versions and facts are sorted once over all tasks and cut into ``ranges``
      of about equal size (by default, as many as shuffle partitions); the last version of
      each range is carried on to the next ones. Neither a key nor a day binds a task: for
      keys that hold a large share of all facts. Overlaps as in ``asof``. The sorted rows
      are stored in the shared folder, since two steps must see the same ranges.

    ``sliced`` and ``asof`` cut the calendar within ``days``; what lies outside goes to the
    first or last slice, so any period is right and a good one is fast. By default
    it spans the days on which versions end and begin, from one aggregate over the
    dimension; the facts are not read for it.

    A fact's time may be a date or a timestamp; the day of it counts. Tables that
    are stored bucketed by the key join without a shuffle, by sort and merge.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    span = dim.select(
        F.col(key).alias("_key"),
        F.col("valid_from").alias("_from"),
        effective_end(F.col("valid_to")).alias("_until"),
        *attributes,
    )
    in_force = day_of(time).between(F.col("_from"), F.col("_until"))
    if strategy == "prefix":
        return _merge_over_ranges(facts, span, key, time, attributes, how, ranges)
    if strategy == "range":
        joined = facts.join(span, (F.col(key) == F.col("_key")) & in_force, how)
        return joined.drop("_key", "_from", "_until")

    first, last = _slice_bounds(dim, days)
    within = lambda day: F.greatest(F.least(day, last), first)
    lower, upper = within(F.col("_from")), within(F.col("_until"))
    touched = F.when(
        F.col("_from") <= F.col("_until"),
        F.sequence(F.trunc(lower, slice_unit), F.trunc(upper, slice_unit), F.expr(_STEPS[slice_unit])),
    )
    by_slice = span.withColumn("_slice", F.explode(touched))
    sliced_facts = facts.withColumn("_fact_slice", F.trunc(within(day_of(time)), slice_unit))
    if strategy == "asof":
        opens_early = F.col("_slice") == F.trunc(first, slice_unit)
        begun = by_slice.withColumn("_day", F.when(opens_early, F.col("_from")).otherwise(F.greatest("_from", "_slice")))
        return _merge_in_order(sliced_facts, begun, key, time, attributes, how)
    joined = sliced_facts.join(
        by_slice,
        (F.col(key) == F.col("_key")) & (F.col("_fact_slice") == F.col("_slice")) & in_force,
        how,
    )
    return joined.drop("_key", "_from", "_until", "_slice", "_fact_slice")


_STEPS = {"year": "INTERVAL 1 YEAR", "quarter": "INTERVAL 3 MONTH", "month": "INTERVAL 1 MONTH"}


def _slice_bounds(dim: DataFrame, days: tuple[date, date] | None) -> tuple[Column, Column]:
    """First and last day between which the calendar is cut; nothing changes outside the default."""
    if days is not None:
        return F.lit(days[0]), F.lit(days[1])
    changes = dim.agg(F.min("valid_to").alias("first"), F.max("valid_from").alias("last"))
    first = F.coalesce(F.least("first", "last"), "last", F.lit(OPEN_END))
    span = changes.select(F.struct(first.alias("first"), F.greatest("first", "last", F.lit(OPEN_START)).alias("last"))).scalar()
    return span["first"], span["last"]


def _merge_in_order(
    facts: DataFrame, by_slice: DataFrame, key: str, time: str, attributes: Sequence[str], how: str
) -> DataFrame:
    """Give each fact the last version begun by its day, if that version is still in force.

    A version enters every slice it touches, at its start or at the slice's; the
    first slice also holds all days before it.
    """
    fact_columns = [c for c in facts.columns if c != "_fact_slice"]
    observed = facts.select(
        F.col(key).alias("_key"),
        F.col("_fact_slice").alias("_slice"),
        day_of(time).alias("_day"),
        F.lit(1).alias("_is_fact"),
        F.struct(*fact_columns).alias("_fact"),
    )
    begun = by_slice.select(
        "_key",
        "_slice",
        "_day",
        F.lit(0).alias("_is_fact"),
        F.struct("_until", *attributes).alias("_version"),
    )
    # A version sorts before a fact of the same day: valid_from is inclusive.
    so_far = (
        Window.partitionBy("_key", "_slice")
        .orderBy("_day", "_is_fact")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    merged = observed.unionByName(begun, allowMissingColumns=True)
    walked = merged.withColumn("_latest", F.last("_version", ignorenulls=True).over(so_far))
    in_force = F.col("_day") <= F.col("_latest._until")
    kept = walked.filter(F.col("_is_fact") == 1)
    if how == "inner":
        kept = kept.filter(in_force)
    return kept.select(
        "_fact.*", *[F.when(in_force, F.col(f"_latest.{a}")).alias(a) for a in attributes]
    )


def _merge_over_ranges(
    facts: DataFrame, span: DataFrame, key: str, time: str, attributes: Sequence[str], how: str, ranges: int | None
) -> DataFrame:
    """Give each fact the last version begun by its day, wherever the sort put it, if that version is still in force.

    Rows are ordered by key, day, kind (a version before the facts of its day) and, among
    facts, a hash, so that even the facts of one key and day spread over ranges.
    """
    spark = facts.sparkSession
    fact = F.struct(*[F.col(f"`{c}`") for c in facts.columns])
    observed = facts.select(
        F.col(key).alias("_key"), day_of(time).alias("_day"), F.lit(1).alias("_is_fact"), F.xxhash64(fact).alias("_tie"), fact.alias("_fact")
    )
    version = F.struct(F.col("_key").alias("_owner"), F.col("_from"), F.col("_until"), *attributes)
    begun = span.select("_key", F.col("_from").alias("_day"), F.lit(0).alias("_is_fact"), F.lit(0).cast("bigint").alias("_tie"), version.alias("_version"))
    order = ("_key", "_day", "_is_fact", "_tie")
    count = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = observed.unionByName(begun, allowMissingColumns=True).repartitionByRange(count, *order)
    cut = stored(merged.withColumn("_range", F.spark_partition_id()), "ranges")

    # A row for each range: its last version, and with it the last one of all ranges before.
    last = cut.groupBy("_range").agg(F.max_by("_version", F.when(F.col("_is_fact") == 0, F.struct("_key", "_day"))).alias("_last"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_range", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))

    so_far = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = cut.withColumn("_within", F.last("_version", ignorenulls=True).over(so_far)).filter(F.col("_is_fact") == 1)
    latest = F.coalesce("_within", "_carried")
    known = walked.join(carried, "_range").withColumn("_latest", latest)
    in_force = F.coalesce((F.col("_latest._owner") == F.col("_key")) & (F.col("_day") <= F.col("_latest._until")), F.lit(False))
    kept = known.filter(in_force) if how == "inner" else known
    return kept.select("_fact.*", *[F.when(in_force, F.col("_latest").getField(a)).alias(a) for a in attributes])


def naive_join(
    facts: DataFrame,
    dim: DataFrame,
    *,
    key: str = "ticker",
    attributes: Sequence[str] = ("gics_sector",),
) -> DataFrame:
    """Join each fact to today's version of its key, whatever its day."""
    today = dim.filter("is_current").select(key, *attributes)
    return facts.join(today, key)


def both_labels(dim: DataFrame, key: str = "ticker", label: str = "gics_sector") -> DataFrame:
    """Versions carrying both their own label and the key's label of today.

    The naive label is attached on the dimension, so the facts are joined once
    instead of twice. Keys without a current version drop out, as they would in
    the naive join. A key with two current versions is an error: see
    ``quality.current_row_violations`` for all of them.
    """
    whole_key = Window.partitionBy(key)
    several = F.count_if(F.col("is_current")).over(whole_key) > 1
    complaint = F.raise_error(F.concat(F.lit("more than one current version of "), F.col(key).cast("string")))
    today = F.when(several, complaint.cast(dim.schema[label].dataType)).otherwise(F.max(F.when(F.col("is_current"), F.col(label))).over(whole_key))
    return require(dim.withColumn("sector_today", today), "sector_today")


def dual_label(
    facts: DataFrame,
    dim: DataFrame,
    *,
    key: str = "ticker",
    time: str = "trade_date",
    label: str = "gics_sector",
    measure: str = "daily_return",
    strategy: str = "range",
) -> DataFrame:
    """Every measured fact with the label of its day and the label of today."""
    versions = both_labels(dim, key, label).withColumnRenamed(label, "sector_at_trade_date")
    joined = pit_join(
        require(facts, measure),
        versions,
        key=key,
        time=time,
        attributes=("version_number", "sector_at_trade_date", "sector_today"),
        strategy=strategy,
    )
    return joined.withColumn(
        "is_misattributed", differs(F.col("sector_at_trade_date"), F.col("sector_today"))
    )


def lookup(
    dim: DataFrame, value, day, *, key: str = "ticker", attributes: Sequence[str] = ("gics_sector",)
) -> DataFrame:
    """Attributes of one key on one day."""
    return dim.filter(
        (F.col(key) == F.lit(value)) & covers(day_of(F.lit(day)), F.col("valid_from"), F.col("valid_to"))
    ).select(*attributes)


def lookup_many(
    dim: DataFrame,
    requests: DataFrame,
    *,
    key: str = "ticker",
    time: str = "as_of",
    attributes: Sequence[str] = ("gics_sector",),
) -> DataFrame:
    """Attributes for a table of (key, day) requests; unknown ones stay, with NULLs."""
    return pit_join(requests, dim, key=key, time=time, attributes=attributes, how="left")


def range_join_count(
    facts: DataFrame,
    dim: DataFrame,
    *,
    key: str = "ticker",
    time: str = "trade_date",
) -> DataFrame:
    """Number of fact and version pairs of the range join."""
    pairs = pit_join(facts.select(key, time), dim, key=key, time=time, attributes=())
    return pairs.agg(F.count(F.lit(1)).alias("joined_rows"))


def exclude(df: DataFrame, holdouts: DataFrame, key: str = "ticker") -> DataFrame:
    return df.join(holdouts.select(key), key, "left_anti")


def scope_to(df: DataFrame, universe: DataFrame, key: str = "ticker") -> DataFrame:
    return df.join(universe.select(key), key, "left_semi")


def mismatches(
    left: DataFrame, right: DataFrame, *, key: str = "ticker", tags: tuple[str, str] = ("left_only", "right_only")
) -> DataFrame:
    """Keys present on one side only, tagged with the side."""
    one_way = lambda a, b, tag: exclude(distinct_keys(a, key), b, key).withColumn(
        "present_in", F.lit(tag)
    )
    return union_all(one_way(left, right, tags[0]), one_way(right, left, tags[1]))


def members_on(
    facts: DataFrame,
    intervals: DataFrame,
    *,
    key: str = "ticker",
    time: str = "trade_date",
    start: str = "start_date",
    end: str = "end_date",
) -> DataFrame:
    """Facts whose key was a member on the fact's day; several intervals per key.

    Overlapping and repeated intervals are merged first, so that a fact meets
    only disjoint ones, however many rows the interval table has.
    """
    spans = merged_intervals(intervals, key=key, start=start, end=end).select(
        F.col(key).alias("_key"), F.col(start).alias("_start"), effective_end(F.col(end)).alias("_end")
    )
    inside = (F.col(key) == F.col("_key")) & day_of(time).between(F.col("_start"), F.col("_end"))
    return facts.join(spans, inside, "left_semi")


def merged_intervals(
    intervals: DataFrame, *, key: str = "ticker", start: str = "start_date", end: str = "end_date"
) -> DataFrame:
    """Disjoint intervals covering the same days.

    Rows are reduced to one per key and start before the ordered pass, which is
    therefore bounded by the calendar for every key.
    """
    longest = (
        intervals.groupBy(key, F.col(start).alias("_from"))
        .agg(F.max(effective_end(F.col(end))).alias("_until"))
        .filter(F.col("_from") <= F.col("_until"))
    )
    in_order = Window.partitionBy(key).orderBy("_from")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    up_to_here = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max("_until").over(before)
    begins = longest.withColumn("_begins", F.coalesce(F.col("_from") > reach, F.lit(True)).cast("int"))
    return (
        begins.withColumn("_island", F.sum("_begins").over(up_to_here))
        .groupBy(key, "_island")
        .agg(F.min("_from").alias(start), F.max("_until").alias("_last"))
        .select(key, start, F.when(F.col("_last") != F.lit(OPEN_END), F.col("_last")).alias(end))
    )


def match_counts(
    facts: DataFrame, dim: DataFrame, *, key: str = "ticker", time: str = "trade_date"
) -> DataFrame:
    """How many versions cover each (key, day) of the facts, times the facts of that day.

    Versions covering a day = versions begun by then minus versions ended before
    it: one ordered pass per key instead of a join. An inverted interval covers
    nothing and is left out.
    """
    upright = dim.filter(F.col("valid_from") <= effective_end(F.col("valid_to")))

    def marks(df: DataFrame, day: str, kind: int, opened: int, seen: int) -> DataFrame:
        return df.select(
            key,
            day_of(day).alias("_day"),
            F.lit(kind).alias("_kind"),
            F.lit(opened).cast("bigint").alias("_opened"),
            F.lit(seen).cast("bigint").alias("_seen"),
        )

    # On one day: versions begin, facts are seen, versions end.
    marked = union_all(
        marks(upright, "valid_from", 0, 1, 0),
        marks(facts, time, 1, 0, 1),
        marks(upright.filter(F.col("valid_to").isNotNull()), "valid_to", 2, -1, 0),
    )
    # One row per key, day and kind, whatever the number of facts or versions.
    per_day = marked.groupBy(key, "_day", "_kind").agg(
        F.sum("_opened").alias("_opened"), F.sum("_seen").alias("_seen")
    )
    in_order = (
        Window.partitionBy(key)
        .orderBy("_day", "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    swept = per_day.withColumn("_open", F.sum("_opened").over(in_order))
    return swept.filter(F.col("_kind") == 1).select(
        key,
        F.col("_day").alias(time),
        (F.col("_open") * F.col("_seen")).alias("matching_dimension_rows"),
    )
