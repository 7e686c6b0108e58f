"""Reports over the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame

from chronoframe.operators import shaping, windows
from chronoframe.plans import reports
from queries.comparing import anchor, daily, fact
from queries.family import Family, r, rs
from queries.mapping import Inputs

FAMILY = Family()


@FAMILY.query(
    f"""SELECT gics_sector, comparison_start, {rs('naive_cumulative_return', 'pit_cumulative_return', 'difference_pp')},
        reclassified_tickers, misattributed_observations FROM anchor_rl ORDER BY abs_difference_pp DESC NULLS LAST""",
    "anchor_rl",
)
def report_anchor(i: Inputs) -> DataFrame:
    return reports.anchor_report(anchor(i, relabel=True))


@FAMILY.query(
    f"""SELECT gics_sector, sector_existed_from, {rs('pct_period_sector_absent', 'naive_full_window_return', 'naive_cumulative_return')}
        FROM anchor_held WHERE pct_period_sector_absent > 0""",
    "anchor_held",
)
def report_absent(i: Inputs) -> DataFrame:
    return reports.absent_report(anchor(i, relabel=True, hold_out=True))


@FAMILY.query(
    f"""SELECT gics_sector, {r('difference_pp')}, comparison_start, analysis_end,
        (SELECT CAST(sum(misattributed_observations) AS BIGINT) FROM anchor) AS role_assignments,
        (SELECT CAST(sum(reclassified_tickers) AS BIGINT) FROM anchor) AS entity_label_moves
        FROM anchor WHERE abs_difference_pp IS NOT NULL ORDER BY abs_difference_pp DESC LIMIT 1""",
    "anchor",
)
def report_kpis(i: Inputs) -> DataFrame:
    return reports.kpi_report(anchor(i))


@FAMILY.query(
    f"""SELECT gics_sector, {rs('difference_pp', 'abs_difference_pp')},
        CASE WHEN difference_pp >= 0 THEN 'overstates' ELSE 'understates' END AS polarity
        FROM anchor_rl WHERE difference_pp IS NOT NULL""",
    "anchor_rl",
)
def report_gap(i: Inputs) -> DataFrame:
    return reports.gap_report(anchor(i, relabel=True))


@FAMILY.query(
    f"""SELECT gics_sector, {rs('naive_cumulative_return', 'pit_cumulative_return', 'abs_difference_pp')}
        FROM anchor WHERE abs_difference_pp IS NOT NULL ORDER BY abs_difference_pp DESC, gics_sector LIMIT 3""",
    "anchor",
)
def report_top_pairs(i: Inputs) -> DataFrame:
    return reports.pair_report(anchor(i), 3)


@FAMILY.query(
    f"""SELECT gics_sector, {rs('naive_cumulative_return', 'pit_cumulative_return')},
        CASE gics_sector WHEN '4-NOT SPECIFIED' THEN 1 ELSE 2 END AS display_order
        FROM anchor WHERE gics_sector IN ('4-NOT SPECIFIED', '1-URGENT')""",
    "anchor",
)
def report_shortlist(i: Inputs) -> DataFrame:
    chosen = anchor(i).select("gics_sector", "naive_cumulative_return", "pit_cumulative_return")
    return shaping.in_order(chosen, "gics_sector", ["4-NOT SPECIFIED", "1-URGENT"])


@FAMILY.query(
    f"""SELECT gics_sector, trade_date, {r('100 * (cumulative_index - 1)', 'cumulative_pct')}, gics_sector = '5-LOW' AS is_focal
FROM (SELECT *, exp(sum(ln(1 + greatest(mean_return, -0.9999))) OVER (
          PARTITION BY join_basis, gics_sector ORDER BY trade_date ROWS UNBOUNDED PRECEDING)) AS cumulative_index
      FROM daily_rl) WHERE join_basis = 'point_in_time'""",
    "daily_rl",
)
def report_series(i: Inputs) -> DataFrame:
    return reports.series_report(windows.cumulative_index(daily(i, relabel=True)), "point_in_time", "5-LOW")


@FAMILY.query("SELECT DISTINCT sector_at_trade_date AS gics_sector FROM fact_rl ORDER BY 1", "fact_rl")
def report_labels(i: Inputs) -> DataFrame:
    labelled = shaping.select_as(fact(i, relabel=True), {"sector_at_trade_date": "gics_sector"})
    return shaping.sorted_labels(labelled, "gics_sector")


@FAMILY.query(
    """
SELECT 'dim_sector_scd' AS table_name, count(*) AS row_count FROM dim
UNION ALL SELECT 'fact_returns', count(*) FROM returns
UNION ALL SELECT 'fact_returns_pit', count(*) FROM fact""",
    "dim",
    "returns",
    "fact",
)
def report_table_counts(i: Inputs) -> DataFrame:
    return reports.table_counts(
        {"dim_sector_scd": i.dim(), "fact_returns": i.returns(), "fact_returns_pit": fact(i)}
    )
