from datetime import date

import pytest

from chronoframe.model import ReportingWindow
from chronoframe.operators import comparison
from chronoframe.plans import reports

W = ReportingWindow.of("2020-01-01", "2020-01-31")
FACT = "ticker:s trade_date:d daily_return:f sector_at_trade_date:s sector_today:s is_misattributed:b"


@pytest.fixture
def fact(frame):
    """A and B move from OLD to NEW on the 3rd; OLD is nobody's label today; C stays in KEEP."""
    rows = [
        ("A", "2019-12-31", 9.0, "OLD", "NEW", True),  # before the window
        ("A", "2020-01-01", 0.10, "OLD", "NEW", True),
        ("B", "2020-01-01", 0.20, "OLD", "NEW", True),
        ("C", "2020-01-01", 0.01, "KEEP", "KEEP", False),
        ("A", "2020-01-02", 0.10, "OLD", "NEW", True),
        ("C", "2020-01-02", 0.02, "KEEP", "KEEP", False),
        ("A", "2020-01-03", 0.30, "NEW", "NEW", False),
        ("B", "2020-01-03", 0.10, "NEW", "NEW", False),
        ("C", "2020-01-03", 0.03, "KEEP", "KEEP", False),
    ]
    return frame(FACT, rows)


@pytest.fixture
def dim(frame):
    return frame(
        "ticker:s gics_sector:s valid_from:d valid_to:d is_current:b version_number:i change_reason:s",
        [
            ("A", "OLD", "1900-01-01", "2020-01-02", False, 1, "initial"),
            ("A", "NEW", "2020-01-03", None, True, 2, "reclassification"),
            ("B", "OLD", "1900-01-01", "2020-01-02", False, 1, "initial"),
            ("B", "NEW", "2020-01-03", None, True, 2, "sector_rename"),
            ("C", "KEEP", "1900-01-01", None, True, 1, "initial"),
        ],
    )


def test_daily_means_on_both_bases(fact):
    daily = {
        (r.join_basis, r.gics_sector, r.trade_date.day): (r.constituent_count, round(r.mean_return, 10))
        for r in comparison.group_daily(fact, W).collect()
    }
    assert daily[("naive", "NEW", 1)] == (2, 0.15)
    assert daily[("point_in_time", "OLD", 1)] == (2, 0.15)
    assert daily[("point_in_time", "NEW", 3)] == (2, 0.2)
    assert ("point_in_time", "NEW", 1) not in daily and ("naive", "OLD", 1) not in daily
    assert ("naive", "NEW", 31) not in daily


def test_fused_pairs_equal_the_stepwise_ones(fact, rows):
    daily = comparison.group_daily(fact, W)
    columns = ("gics_sector", "naive_cumulative_return", "pit_cumulative_return", "exists_in_naive_basis", "exists_in_pit_basis")
    stepwise = rows(comparison.pair_bases(comparison.comparable(daily)), *columns)
    fused = rows(comparison.rebased_pairs(daily), *columns)
    assert [r[0] for r in stepwise] == [r[0] for r in fused]
    for a, b in zip(stepwise, fused):
        assert a[3:] == b[3:]
        assert a[1] == pytest.approx(b[1]) and a[2] == pytest.approx(b[2])


def test_comparison_window(fact, rows):
    assert rows(comparison.comparison_window(comparison.group_daily(fact, W))) == [
        ("KEEP", date(2020, 1, 1), 2),
        ("NEW", date(2020, 1, 3), 2),
        ("OLD", date(2020, 1, 1), 1),
    ]


def anchor(fact, dim):
    return comparison.anchor_metric(comparison.group_daily(fact, W), fact, dim, W)


def test_anchor_metric(fact, dim):
    got = {r.gics_sector: r for r in anchor(fact, dim).collect()}
    new = got["NEW"]
    # Born on the 3rd: compared from then on, equal on both bases from then on.
    assert new.comparison_start == date(2020, 1, 3)
    assert new.naive_cumulative_return == pytest.approx(20.0)
    assert new.difference_pp == pytest.approx(0.0)
    assert new.naive_full_window_return == pytest.approx(100 * (1.15 * 1.1 * 1.2 - 1))
    assert (new.trading_days_in_window, new.trading_days_sector_absent) == (3, 2)
    assert new.pct_period_sector_absent == 66.6667
    assert (new.misattributed_observations, new.reclassified_tickers) == (3, 2)
    old = got["OLD"]
    # Retired: present on one basis only, and still reported.
    assert (old.exists_in_naive_basis, old.exists_in_pit_basis) == (False, True)
    assert old.naive_cumulative_return is None and old.difference_pp is None
    assert old.pct_period_sector_absent == 0.0
    keep = got["KEEP"]
    assert (keep.misattributed_observations, keep.reclassified_tickers) == (0, 0)
    assert keep.sector_existed_from == date(1900, 1, 1)
    assert (keep.analysis_start, keep.analysis_end) == (W.start, W.end)
    assert len(anchor(fact, dim).columns) == 17


def test_anchor_needs_no_cross_join(fact, dim):
    plan = anchor(fact, dim)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_misattribution_can_ignore_renames(fact, dim, rows):
    real = comparison.misattribution(fact, W, exclude_reasons=("sector_rename",), dim=dim)
    assert rows(real) == [("NEW", 2, 1), ("OLD", 2, 1)]
    with pytest.raises(ValueError, match="dimension"):
        comparison.misattribution(fact, W, exclude_reasons=("sector_rename",))


def test_totals_count_roles_and_the_distinct_form_counts_once(fact, dim, rows):
    assert rows(anchor(fact, dim).agg(*comparison.kpi_totals())) == [(6, 4)]
    assert rows(comparison.distinct_misattribution(fact, W)) == [(3, 2)]


def test_absent_days(fact, dim, rows):
    assert rows(comparison.absent_days(dim, fact, W)) == [
        ("KEEP", date(1900, 1, 1), 3, 0),
        ("NEW", date(2020, 1, 3), 3, 2),
        ("OLD", date(1900, 1, 1), 3, 0),
    ]


def test_group_summary_pushes_both_filters(spark, fact, tmp_path):
    path = str(tmp_path / "fact")
    fact.write.parquet(path)
    df = comparison.group_summary(spark.read.parquet(path), "OLD", ReportingWindow.of("2020-01-01", "2020-01-02"))
    assert [tuple(r) for r in df.collect()] == [("OLD", 3, pytest.approx(0.4 / 3))]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(sector_at_trade_date,OLD)" in plan and "LessThanOrEqual(trade_date,2020-01-02)" in plan
    assert "ticker" not in plan.split("ReadSchema")[1]


ANCHOR = (
    "gics_sector:s comparison_start:d naive_cumulative_return:f pit_cumulative_return:f difference_pp:f "
    "abs_difference_pp:f naive_full_window_return:f reclassified_tickers:l misattributed_observations:l "
    "sector_existed_from:d pct_period_sector_absent:f analysis_end:d"
)


@pytest.fixture
def finished(frame):
    day = "2020-01-01"
    return frame(ANCHOR, [
        ("IT", day, 812.1, 733.9, 78.2, 78.2, 812.1, 17, 100, day, 0.0, day),
        ("FIN", day, 344.9, 349.5, -4.6, 4.6, 344.9, 8, 40, day, 0.0, day),
        ("FLAT", day, 1.0, 1.0, -0.0, 0.0, 1.0, 0, 0, day, 0.0, day),
        ("TEL", day, None, 19.5, None, None, None, 3, 9, day, 0.0, day),
        ("COM", day, 153.5, 150.0, 3.5, 3.5, 266.0, 9, 50, "2018-09-24", 21.4, day),
    ])


def test_reports(finished):
    order = [r.gics_sector for r in reports.anchor_report(finished).collect()]
    assert order == ["IT", "FIN", "COM", "FLAT", "TEL"]
    gap = {r.gics_sector: r.polarity for r in reports.gap_report(finished).collect()}
    assert gap == {"IT": "overstates", "FIN": "understates", "FLAT": "overstates", "COM": "overstates"}
    assert [r.gics_sector for r in reports.gap_report(finished).collect()] == ["FLAT", "COM", "FIN", "IT"]
    assert [r.gics_sector for r in reports.absent_report(finished).collect()] == ["COM"]
    assert [r.gics_sector for r in reports.pair_report(finished, 2).collect()] == ["IT", "FIN"]
    kpi = reports.kpi_report(finished).first()
    assert (kpi.gics_sector, kpi.role_assignments, kpi.entity_label_moves) == ("IT", 199, 37)


def test_inverted_window_is_refused():
    with pytest.raises(ValueError, match="must precede"):
        ReportingWindow.of("2020-02-01", "2020-01-01")
    with pytest.raises(ValueError, match="must precede"):
        ReportingWindow.of("2020-02-01", "2020-02-01")


@pytest.mark.parametrize(
    ("start", "end", "whole"),
    [("2020-01-01", "2020-03-31", (1, 3)), ("2020-01-02", "2020-03-31", (2, 3)), ("2020-01-01", "2020-03-30", (1, 2)), ("2020-01-31", "2020-03-01", (2, 2)),
     ("2020-01-02", "2020-02-28", None), ("2020-01-05", "2020-01-20", None), ("2020-02-01", "2020-02-29", (2, 2))],
)
def test_ranges_from_months_and_their_edges(spark, start, end, whole):
    window = ReportingWindow.of(start, end)
    found = comparison.whole_months(window)
    assert (None if found is None else tuple(d.month for d in found)) == whole
    fact = spark.range(400).selectExpr(
        "IF(id % 3 = 0, 'OTHER', 'OLD') AS sector_at_trade_date", "date_add(DATE '2019-12-20', CAST(id % 120 AS INT)) AS trade_date",
        "IF(id % 7 = 0, NULL, id / 8.0D) AS daily_return",
    )
    months = comparison.month_summary(fact)
    got = comparison.group_summary_by_months(fact, months, "OLD", window).first()
    wanted = comparison.group_summary(fact, "OLD", window).first()
    assert got.observations == wanted.observations and got.mean_return == pytest.approx(wanted.mean_return)


def test_whole_months_do_not_read_the_fact(spark, fact, tmp_path):
    fact.write.parquet(str(tmp_path / "fact"))
    stored = spark.read.parquet(str(tmp_path / "fact"))
    comparison.month_summary(stored).write.parquet(str(tmp_path / "months"))
    months = spark.read.parquet(str(tmp_path / "months"))
    df = comparison.group_summary_by_months(stored, months, "OLD", ReportingWindow.of("2020-01-01", "2020-02-29"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "/months" in plan and "/fact" not in plan


def test_the_summary_of_the_fact_gives_the_same_comparison(spark, rows):
    """Moved and unmoved observations, labels of one basis only, keys that moved twice, days outside of the window."""
    fact = spark.range(600).selectExpr(
        "concat('K', id % 17) AS ticker", "date_add(DATE '2019-12-25', CAST(id % 50 AS INT)) AS trade_date", "((id * 37) % 101 - 50) / 4096.0D AS daily_return",
        "IF(id % 17 < 5, 'OLD', concat('L', id % 3)) AS sector_at_trade_date", "IF(id % 17 < 3, 'NEW', IF(id % 17 < 5, 'OLD', concat('L', id % 2))) AS sector_today",
    ).selectExpr("*", "sector_at_trade_date <> sector_today AS is_misattributed")
    dim = spark.sql("SELECT * FROM VALUES ('A', 'OLD', DATE '1900-01-01'), ('B', 'NEW', DATE '2020-01-10'), ('C', 'L1', DATE '2020-01-03') AS t(ticker, gics_sector, valid_from)")
    window = ReportingWindow.of("2020-01-01", "2020-01-31")
    direct = comparison.anchor_metric(comparison.group_daily(fact, window), fact, dim, window)
    summed = comparison.anchor_of_summary(comparison.fact_summary(fact, window), dim, window)
    assert summed.columns == direct.columns
    shown = lambda df: [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows(df)]
    assert shown(summed) == shown(direct) and len(rows(direct)) > 3
