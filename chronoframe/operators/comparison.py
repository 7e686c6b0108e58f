"""Group series on two bases and the gap between them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions import compound, distinct_from, pct, present
from chronoframe.model import NAIVE, POINT_IN_TIME, ReportingWindow
from chronoframe.operators.scd2 import group_birth
from chronoframe.operators.shaping import in_window, label_in_range, to_bases, union_all

LABEL_OF_BASIS = {POINT_IN_TIME: "sector_at_trade_date", NAIVE: "sector_today"}
_LABEL = "gics_sector"


def day_cube(fact: DataFrame, window: ReportingWindow) -> DataFrame:
    """Counts and sums per (label of the day, label of today, day).

    Everything the daily series needs, reduced map-side before any shuffle: its
    size is label pairs times days, whatever the number of facts.
    """
    return (
        in_window(fact, "trade_date", window)
        .groupBy("sector_at_trade_date", "sector_today", "trade_date")
        .agg(
            F.count(F.lit(1)).alias("observations"),
            F.count("daily_return").alias("measured"),
            F.sum("daily_return").alias("return_sum"),
        )
    )


def daily_from_cube(cube: DataFrame) -> DataFrame:
    """Unpivot the two labels of the cube and finish the means."""
    sides = to_bases(cube, LABEL_OF_BASIS, _LABEL, ["trade_date", "observations", "measured", "return_sum"])
    return sides.groupBy("join_basis", _LABEL, "trade_date").agg(
        F.sum("observations").alias("constituent_count"),
        (F.sum("return_sum") / F.nullif(F.sum("measured"), F.lit(0))).alias("mean_return"),
    )


def group_daily(fact: DataFrame, window: ReportingWindow) -> DataFrame:
    """Equal-weighted mean return per basis, label and day."""
    return daily_from_cube(day_cube(fact, window))


def series_bounds(daily: DataFrame) -> DataFrame:
    return daily.groupBy("join_basis", _LABEL).agg(F.min("trade_date").alias("first_date"))


def comparison_window(daily: DataFrame) -> DataFrame:
    """The later of the two series starts per label, and how many bases have one."""
    return series_bounds(daily).groupBy(_LABEL).agg(
        F.max("first_date").alias("comparison_start"),
        F.count(F.lit(1)).alias("bases_present"),
    )


def full_window_naive(daily: DataFrame) -> DataFrame:
    return (
        daily.filter(F.col("join_basis") == NAIVE)
        .groupBy(_LABEL)
        .agg(compound(F.col("mean_return")).alias("cumulative_return"))
    )


def comparable(daily: DataFrame) -> DataFrame:
    """Total return per basis and label over the common period."""
    rebased = daily.join(comparison_window(daily), _LABEL).filter(
        F.col("trade_date") >= F.col("comparison_start")
    )
    return rebased.groupBy("join_basis", _LABEL).agg(
        compound(F.col("mean_return")).alias("cumulative_return")
    )


def pair_bases(totals: DataFrame, value: str = "cumulative_return") -> DataFrame:
    """One row per label with both bases side by side.

    A label of one basis only survives, flagged. Grouping replaces a full outer
    join of the table with itself.
    """
    of = lambda name: F.max(F.when(F.col("join_basis") == name, F.col(value)))
    has = lambda name: F.bool_or(F.col("join_basis") == name)
    return totals.groupBy(_LABEL).agg(
        of(NAIVE).alias("naive_cumulative_return"),
        of(POINT_IN_TIME).alias("pit_cumulative_return"),
        has(NAIVE).alias("exists_in_naive_basis"),
        has(POINT_IN_TIME).alias("exists_in_pit_basis"),
    )


def rebased_pairs(daily: DataFrame) -> DataFrame:
    """``pair_bases(comparable(daily))`` with window and full-window figures, in one shuffle.

    All of it is conditional aggregation over one label's days: the start of
    each basis comes from an unordered window on the label, the rest from a
    grouping that reuses the same partitioning.
    """
    by_label = Window.partitionBy(_LABEL)
    day, mean = F.col("trade_date"), F.col("mean_return")
    is_naive, is_pit = F.col("join_basis") == NAIVE, F.col("join_basis") == POINT_IN_TIME
    placed = daily.withColumns(
        {
            "_naive_start": F.min(F.when(is_naive, day)).over(by_label),
            "_pit_start": F.min(F.when(is_pit, day)).over(by_label),
        }
    )
    start = F.greatest(F.col("_naive_start"), F.col("_pit_start"))
    common = day >= start
    return placed.groupBy(_LABEL).agg(
        F.max(start).alias("comparison_start"),
        F.max(
            present(F.col("_naive_start")).cast("int") + present(F.col("_pit_start")).cast("int")
        ).alias("bases_present"),
        compound(mean, is_naive & common).alias("naive_cumulative_return"),
        compound(mean, is_pit & common).alias("pit_cumulative_return"),
        compound(mean, is_naive).alias("naive_full_window_return"),
        F.bool_or(is_naive & common).alias("exists_in_naive_basis"),
        F.bool_or(is_pit & common).alias("exists_in_pit_basis"),
    )


def misattribution(
    fact: DataFrame, window: ReportingWindow, *, exclude_reasons: Sequence[str] = (), dim: DataFrame | None = None
) -> DataFrame:
    """Observations and entities a naive join moves, per label, in both directions.

    An observation counts for the label it left and for the label it landed
    under. ``exclude_reasons`` drops keys whose changes are all of the given
    kinds, for which the dimension is needed.
    """
    moved = in_window(fact, "trade_date", window).filter("is_misattributed")
    if exclude_reasons:
        if dim is None:
            raise ValueError("exclude_reasons needs the dimension")
        real_moves = dim.filter(
            ~F.col("change_reason").isin([*exclude_reasons, "initial"])
        ).select("ticker")
        moved = moved.join(real_moves, "ticker", "left_semi")
    both = to_bases(moved, LABEL_OF_BASIS, _LABEL, ["ticker"])
    return both.groupBy(_LABEL).agg(
        F.count(F.lit(1)).alias("misattributed_observations"),
        F.count_distinct("ticker").alias("reclassified_tickers"),
    )


def trading_days(fact: DataFrame, window: ReportingWindow, time: str = "trade_date") -> DataFrame:
    return in_window(fact, time, window).agg(
        F.count_distinct(time).alias("trading_days_in_window")
    )


def _calendar(days: DataFrame, window: ReportingWindow):
    """Scalar: the distinct observed days as an array, at most ``window.calendar_days`` long."""
    return in_window(days, "trade_date", window).agg(F.collect_set("trade_date")).scalar()


def absent_days(dim: DataFrame, days: DataFrame, window: ReportingWindow) -> DataFrame:
    """Observed days before each label was first carried by any version.

    ``days`` is any table with the observed days. They are reduced to a
    calendar first, so no date-only join is needed. Labels present from the
    start keep a zero.
    """
    born = group_birth(dim).withColumn("_calendar", _calendar(days, window))
    before = F.filter(F.col("_calendar"), lambda day: day < F.col("sector_existed_from"))
    return born.select(
        _LABEL,
        "sector_existed_from",
        F.size("_calendar").cast("bigint").alias("trading_days_in_window"),
        F.size(before).cast("bigint").alias("trading_days_sector_absent"),
    )


def assemble(base: DataFrame, parts: Sequence[DataFrame], key: str = _LABEL) -> DataFrame:
    """Left-join one-row-per-key parts onto the base."""
    for part in parts:
        base = base.join(part, key, "left")
    return base


def fact_summary(fact: DataFrame, window: ReportingWindow) -> DataFrame:
    """All that the comparison needs of the labelled fact, in one aggregation over it.

    Rows with a day are the ``day_cube``; rows with a ticker count the observations of a key
    that a naive join moves, per label of the day and label of today. Both are reduced where
    the fact is read, and a row of the fact counts for the second only if it is moved.
    """
    labels = ("sector_at_trade_date", "sector_today")
    none = lambda c: F.lit(None).cast(fact.schema[c].dataType).alias(c)
    of_day = F.struct(F.col("trade_date"), none("ticker"))
    of_key = F.when(F.col("is_misattributed"), F.struct(none("trade_date"), F.col("ticker")))
    marked = in_window(fact, "trade_date", window).select(*labels, "daily_return", F.explode(F.array_compact(F.array(of_day, of_key))).alias("_of"))
    return marked.groupBy(*labels, "_of.trade_date", "_of.ticker").agg(
        F.count(F.lit(1)).alias("observations"),
        F.count("daily_return").alias("measured"),
        F.sum("daily_return").alias("return_sum"),
    )


def moved_of_summary(summary: DataFrame) -> DataFrame:
    """``misattribution`` from a summary of the fact."""
    moved = summary.filter(F.col("ticker").isNotNull())
    return to_bases(moved, LABEL_OF_BASIS, _LABEL, ["ticker", "observations"]).groupBy(_LABEL).agg(
        F.sum("observations").alias("misattributed_observations"),
        F.count_distinct("ticker").alias("reclassified_tickers"),
    )


def anchor_of_summary(summary: DataFrame, dim: DataFrame, window: ReportingWindow) -> DataFrame:
    """``anchor_metric`` from a summary of the fact, which is read several times: store it first."""
    daily = daily_from_cube(summary.filter(F.col("trade_date").isNotNull()))
    return _anchor(daily, moved_of_summary(summary), dim, window)


def anchor_metric(
    daily: DataFrame,
    fact: DataFrame,
    dim: DataFrame,
    window: ReportingWindow,
    *,
    exclude_reasons: Sequence[str] = (),
) -> DataFrame:
    """One row per label: what joining with today's label costs.

    ``daily`` has one row per basis, label and day, and so has the calendar in it:
    the fact itself is read for the moved observations only.
    """
    return _anchor(daily, misattribution(fact, window, exclude_reasons=exclude_reasons, dim=dim), dim, window)


def _anchor(daily: DataFrame, moved: DataFrame, dim: DataFrame, window: ReportingWindow) -> DataFrame:
    pairs = rebased_pairs(daily).withColumn("_calendar", _calendar(daily, window))
    joined = assemble(pairs, [moved, group_birth(dim)])
    before = F.filter(F.col("_calendar"), lambda day: day < F.col("sector_existed_from"))
    total = F.size("_calendar").cast("bigint")
    absent = F.when(F.col("sector_existed_from").isNull(), F.lit(0)).otherwise(F.size(before)).cast("bigint")
    gap = (F.col("naive_cumulative_return") - F.col("pit_cumulative_return")) * F.lit(100.0)
    zero = F.lit(0).cast("bigint")
    return joined.select(
        _LABEL,
        F.lit(window.start).alias("analysis_start"),
        F.lit(window.end).alias("analysis_end"),
        "comparison_start",
        (F.col("naive_cumulative_return") * F.lit(100.0)).alias("naive_cumulative_return"),
        (F.col("pit_cumulative_return") * F.lit(100.0)).alias("pit_cumulative_return"),
        gap.alias("difference_pp"),
        F.abs(gap).alias("abs_difference_pp"),
        (F.col("naive_full_window_return") * F.lit(100.0)).alias("naive_full_window_return"),
        "exists_in_naive_basis",
        "exists_in_pit_basis",
        F.coalesce("reclassified_tickers", zero).alias("reclassified_tickers"),
        F.coalesce("misattributed_observations", zero).alias("misattributed_observations"),
        "sector_existed_from",
        total.alias("trading_days_in_window"),
        absent.alias("trading_days_sector_absent"),
        pct(absent, total).alias("pct_period_sector_absent"),
    )


def group_summary(fact: DataFrame, value: str, window: ReportingWindow, label: str = "sector_at_trade_date") -> DataFrame:
    """Count and mean return of one label over a date range; both filters reach the scan."""
    return (
        label_in_range(fact, label, "trade_date", value, window)
        .groupBy(label)
        .agg(F.count(F.lit(1)).alias("observations"), F.avg("daily_return").alias("mean_return"))
    )


def month_summary(fact: DataFrame, label: str = "sector_at_trade_date", time: str = "trade_date") -> DataFrame:
    """Counts and sums per label and month: to be stored, for ranges that cover whole months."""
    return fact.groupBy(label, F.trunc(F.col(time), "month").alias("month")).agg(
        F.count(F.lit(1)).alias("observations"), F.count("daily_return").alias("measured"), F.sum("daily_return").alias("return_sum")
    )


def whole_months(window: ReportingWindow) -> tuple[date, date] | None:
    """First day of the first and of the last month that lie within the window."""
    after = lambda day: (day.replace(day=28) + timedelta(days=4)).replace(day=1)
    first = window.start if window.start.day == 1 else after(window.start)
    past = (window.end + timedelta(days=1)).replace(day=1)  # the first month that is not whole, or the next one
    return (first, (past - timedelta(days=1)).replace(day=1)) if first < past else None


def group_summary_by_months(
    fact: DataFrame, months: DataFrame, value: str, window: ReportingWindow, label: str = "sector_at_trade_date", time: str = "trade_date"
) -> DataFrame:
    """``group_summary`` from a ``month_summary``; the fact is read for the days outside of whole months only, or not at all."""
    parts = ("observations", "measured", "return_sum")
    of_label = F.col(label) == F.lit(value)
    whole = whole_months(window)
    edges = window.contains(F.col(time))
    found = []
    if whole:
        first, last = whole
        found.append(months.filter(of_label & F.col("month").between(F.lit(first), F.lit(last))).select(label, *parts))
        past = (last.replace(day=28) + timedelta(days=4)).replace(day=1)
        day = F.col(time).cast("date")
        sides = [day.between(F.lit(low), F.lit(high)) for low, high in ((window.start, first - timedelta(days=1)), (past, window.end)) if low <= high]
        edges = reduce(lambda a, b: a | b, sides) if sides else None
    if edges is not None:
        found.append(month_summary(fact.filter(of_label & edges), label, time).select(label, *parts))
    return union_all(*found).groupBy(label).agg(
        F.sum("observations").alias("observations"), (F.sum("return_sum") / F.nullif(F.sum("measured"), F.lit(0))).alias("mean_return")
    )


def kpi_totals() -> tuple[Column, Column]:
    """Totals over the labels. They count each observation under both labels."""
    return (
        F.sum("misattributed_observations").alias("role_assignments"),
        F.sum("reclassified_tickers").alias("entity_label_moves"),
    )


def distinct_misattribution(fact: DataFrame, window: ReportingWindow) -> DataFrame:
    """Each misattributed observation and each entity counted once."""
    moved = in_window(fact, "trade_date", window).filter(
        distinct_from(F.col("sector_at_trade_date"), F.col("sector_today"))
    )
    return moved.agg(
        F.count(F.lit(1)).alias("distinct_observations"),
        F.count_distinct("ticker").alias("distinct_entities"),
    )
