"""Group series on both bases and the headline comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.model import ReportingWindow
from chronoframe.operators import comparison, joins, scd2, windows
from queries.family import Family, r, rs
from queries.mapping import WINDOW, Inputs

FAMILY = Family()
DAILY = f"SELECT join_basis, gics_sector, trade_date, constituent_count, {r('mean_return')}"
ANCHOR = f"""gics_sector, analysis_start, analysis_end, comparison_start,
    {rs('naive_cumulative_return', 'pit_cumulative_return', 'difference_pp', 'abs_difference_pp', 'naive_full_window_return')},
    exists_in_naive_basis, exists_in_pit_basis, reclassified_tickers, misattributed_observations,
    sector_existed_from, trading_days_in_window, trading_days_sector_absent, {r('pct_period_sector_absent')}"""


def fact(i: Inputs, relabel: bool = False) -> DataFrame:
    return joins.dual_label(i.returns(), i.dim(relabel))


def daily(i: Inputs, relabel: bool = False) -> DataFrame:
    return comparison.group_daily(fact(i, relabel), WINDOW)


def anchor(i: Inputs, relabel: bool = False, hold_out: bool = False) -> DataFrame:
    """``hold_out`` leaves out customers whose history claims 5-LOW before it existed.

    The dimension and the summary of the fact have several readers each and are stored; the
    fact itself has one and is never written.
    """
    dim = i.stored("dimension", i.dim(relabel))
    if hold_out:
        early = scd2.existence_violations(dim, i.registry(), WINDOW).filter(F.col("gics_sector") == "5-LOW")
        dim = joins.exclude(dim, early.select("ticker").distinct())
    labelled = joins.dual_label(i.returns(), dim).select(
        "ticker", "trade_date", "daily_return", "sector_at_trade_date", "sector_today", "is_misattributed"
    )
    summary = i.stored("fact summary", comparison.fact_summary(labelled, WINDOW))
    return comparison.anchor_of_summary(summary, dim, WINDOW)


@FAMILY.query(DAILY + " FROM daily", "daily")
def group_daily(i: Inputs) -> DataFrame:
    return daily(i)


@FAMILY.query(
    f"""SELECT join_basis, gics_sector, trade_date, count(*) AS constituent_count,
        {r("avg(CASE WHEN CAST(round(daily_return * 1000000) AS BIGINT) % 2 = 0 THEN daily_return END)", 'mean_return')}
        FROM roles GROUP BY join_basis, gics_sector, trade_date""",
    "roles",
)
def group_daily_null_returns(i: Inputs) -> DataFrame:
    """Every other return, by its last digit, is missing; a mean is over those present."""
    even = F.floor(F.col("daily_return") * 1000000 + 0.5).cast("bigint") % 2 == 0
    return comparison.group_daily(fact(i).withColumn("daily_return", F.when(even, F.col("daily_return"))), WINDOW)


@FAMILY.query(DAILY + " FROM daily_rl", "daily_rl")
def group_daily_relabelled(i: Inputs) -> DataFrame:
    return daily(i, relabel=True)


@FAMILY.query(
    f"""
SELECT join_basis, gics_sector, trade_date, {r('mean_return')}, {r('cumulative_index')}, {r('cumulative_index - 1', 'cumulative_return')}
FROM (SELECT *, exp(sum(ln(1 + greatest(mean_return, -0.9999))) OVER (
          PARTITION BY join_basis, gics_sector ORDER BY trade_date ROWS UNBOUNDED PRECEDING)) AS cumulative_index
      FROM daily)""",
    "daily",
)
def cumulative_index(i: Inputs) -> DataFrame:
    return windows.cumulative_index(daily(i))


@FAMILY.query(
    "SELECT join_basis, gics_sector, min(trade_date) AS first_date FROM daily_rl GROUP BY ALL", "daily_rl"
)
def series_bounds(i: Inputs) -> DataFrame:
    return comparison.series_bounds(daily(i, relabel=True))


@FAMILY.query("SELECT gics_sector, comparison_start, bases_present FROM labels_rl", "labels_rl")
def comparison_window(i: Inputs) -> DataFrame:
    return comparison.comparison_window(daily(i, relabel=True))


@FAMILY.query(
    f"""SELECT 'naive' AS join_basis, gics_sector, {r('naive_common', 'cumulative_return')} FROM labels_rl WHERE naive_common IS NOT NULL
        UNION ALL SELECT 'point_in_time', gics_sector, {r('pit_common', 'cumulative_return')} FROM labels_rl WHERE pit_common IS NOT NULL""",
    "labels_rl",
)
def comparable_returns(i: Inputs) -> DataFrame:
    return comparison.comparable(daily(i, relabel=True))


@FAMILY.query(f"SELECT gics_sector, {r('naive_whole', 'cumulative_return')} FROM labels_rl WHERE naive_whole IS NOT NULL", "labels_rl")
def full_window_naive(i: Inputs) -> DataFrame:
    return comparison.full_window_naive(daily(i, relabel=True))


@FAMILY.query(
    f"""SELECT gics_sector, {r('naive_common', 'naive_cumulative_return')}, {r('pit_common', 'pit_cumulative_return')},
        naive_common IS NOT NULL AS exists_in_naive_basis, pit_common IS NOT NULL AS exists_in_pit_basis FROM labels_rl""",
    "labels_rl",
)
def paired_bases(i: Inputs) -> DataFrame:
    return comparison.pair_bases(comparison.comparable(daily(i, relabel=True)))


@FAMILY.query("SELECT * FROM movers", "movers")
def misattribution(i: Inputs) -> DataFrame:
    return comparison.misattribution(fact(i), WINDOW)


@FAMILY.query(
    """
SELECT gics_sector, count(*) AS misattributed_observations, count(DISTINCT ticker) AS reclassified_tickers
FROM moved_rl SEMI JOIN (SELECT ticker FROM dim_rl WHERE change_reason = 'reclassification') real USING (ticker)
GROUP BY gics_sector""",
    "moved_rl",
)
def misattribution_without_renames(i: Inputs) -> DataFrame:
    return comparison.misattribution(
        fact(i, relabel=True), WINDOW, exclude_reasons=("sector_rename",), dim=i.dim(relabel=True)
    )


@FAMILY.query(
    "SELECT count(*) AS distinct_observations, count(DISTINCT ticker) AS distinct_entities FROM moved WHERE join_basis = 'naive'", "moved"
)
def misattribution_counted_once(i: Inputs) -> DataFrame:
    return comparison.distinct_misattribution(fact(i), WINDOW)


@FAMILY.query("SELECT count(*) AS trading_days_in_window FROM days", "days")
def trading_days(i: Inputs) -> DataFrame:
    measured = i.returns().filter(F.col("daily_return").isNotNull())
    return comparison.trading_days(measured, WINDOW)


@FAMILY.query(f"SELECT {ANCHOR} FROM anchor", "anchor")
def anchor_metric(i: Inputs) -> DataFrame:
    return anchor(i)


@FAMILY.query(f"SELECT {ANCHOR} FROM anchor_rl", "anchor_rl")
def anchor_metric_relabelled(i: Inputs) -> DataFrame:
    return anchor(i, relabel=True)


@FAMILY.query(f"SELECT {ANCHOR} FROM anchor_held", "anchor_held")
def anchor_metric_held_out(i: Inputs) -> DataFrame:
    """With the doubtful histories held out, 5-LOW is born within the window."""
    return anchor(i, relabel=True, hold_out=True)


@FAMILY.query(
    f"""
SELECT trade_date, gics_sector,
       {r("max(mean_return) FILTER (join_basis = 'point_in_time')", 'pit_mean_return')},
       {r("max(mean_return) FILTER (join_basis = 'naive')", 'naive_mean_return')}
FROM daily_rl GROUP BY ALL""",
    "daily_rl",
)
def pit_vs_naive_by_day(i: Inputs) -> DataFrame:
    of = lambda name: F.max(F.when(F.col("join_basis") == name, F.col("mean_return")))
    return daily(i, relabel=True).groupBy("trade_date", "gics_sector").agg(
        of("point_in_time").alias("pit_mean_return"), of("naive").alias("naive_mean_return")
    )


@FAMILY.query(
    f"""
SELECT sector_at_trade_date, count(*) AS observations, {r('avg(daily_return)', 'mean_return')}
FROM fact WHERE sector_at_trade_date = '1-URGENT' AND trade_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'
GROUP BY sector_at_trade_date""",
    "fact",
)
def group_range_agg(i: Inputs) -> DataFrame:
    return comparison.group_summary(fact(i), "1-URGENT", ReportingWindow.of("1997-01-01", "1998-12-31"))


@FAMILY.query(
    f"""
SELECT sector_at_trade_date, count(*) AS observations, {r('avg(daily_return)', 'mean_return')}
FROM fact WHERE sector_at_trade_date = '1-URGENT' AND trade_date BETWEEN DATE '1997-01-11' AND DATE '1998-12-20'
GROUP BY sector_at_trade_date""",
    "fact",
)
def group_range_agg_by_months(i: Inputs) -> DataFrame:
    """22 whole months from a stored summary, the days before and after them from the fact."""
    labelled = i.stored("fact", fact(i))
    months = i.stored("months", comparison.month_summary(labelled))
    return comparison.group_summary_by_months(labelled, months, "1-URGENT", ReportingWindow.of("1997-01-11", "1998-12-20"))
