import math
from datetime import date, timedelta

import pytest

from chronoframe.operators import windows

PRICES = "ticker:s trade_date:d close_price:f"


def by_day(df, column):
    return {str(r.trade_date): r[column] for r in df.collect()}


@pytest.mark.parametrize("slice_unit", [None, "year", "month"])
def test_first_day_has_no_return_and_monday_follows_friday(frame, slice_unit):
    prices = frame(PRICES, [("A", "2020-01-31", 100.0), ("A", "2020-02-03", 110.0), ("B", "2020-02-03", 5.0)])
    got = windows.returns(prices, slice_unit=slice_unit)
    a = by_day(got.filter("ticker = 'A'"), "daily_return")
    assert a["2020-01-31"] is None
    assert a["2020-02-03"] == pytest.approx(0.1)
    assert by_day(got.filter("ticker = 'B'"), "daily_return") == {"2020-02-03": None}


@pytest.mark.parametrize("slice_unit", [None, "month"])
def test_zero_close_and_missing_close(frame, slice_unit):
    prices = frame(
        PRICES,
        [("A", "2020-01-01", 10.0), ("A", "2020-01-02", None), ("A", "2020-02-03", 0.0), ("A", "2020-03-04", 5.0)],
    )
    got = windows.returns(prices, slice_unit=slice_unit)
    assert by_day(got, "daily_return") == {"2020-01-01": None, "2020-02-03": -1.0, "2020-03-04": None}
    assert by_day(got, "log_return") == {"2020-01-01": None, "2020-02-03": None, "2020-03-04": None}


def test_sliced_previous_equals_plain_on_a_hot_key(spark, rows):
    """One key holds most rows, at a time resolution finer than a day, with ties."""
    ticks = spark.range(5000).selectExpr(
        "CASE WHEN id % 5 < 4 THEN 'HOT' ELSE concat('K', id % 11) END AS ticker",
        "timestamp_seconds(1700000000 + (id div 2) * 977) AS at",
        "id",
        "CASE WHEN id % 13 = 0 THEN NULL ELSE CAST(id AS DOUBLE) END AS v",
    )
    plain = windows.previous(ticks, "v", time="at", tie="id")
    sliced = windows.previous(ticks, "v", time="at", tie="id", slice_unit="day")
    assert rows(plain) == rows(sliced, *plain.columns)


def test_sliced_previous_spreads_a_key(spark, frame):
    prices = frame(PRICES, [("A", date(2020, 1, 1) + timedelta(days=d), float(d)) for d in range(40)])
    plan = windows.previous(prices, "close_price", slice_unit="month")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(ticker#" in plan and ", _slice#" in plan


def test_cumulative_index_and_the_floor(frame):
    daily = frame(
        "join_basis:s gics_sector:s trade_date:d mean_return:f",
        [("naive", "IT", "2020-01-01", 0.1), ("naive", "IT", "2020-01-02", -0.5), ("naive", "IT", "2020-01-03", -1.0),
         ("point_in_time", "IT", "2020-01-02", 0.2)],
    )
    got = windows.cumulative_index(daily)
    naive = by_day(got.filter("join_basis = 'naive'"), "cumulative_index")
    assert naive["2020-01-01"] == pytest.approx(1.1)
    assert naive["2020-01-02"] == pytest.approx(0.55)
    assert naive["2020-01-03"] == pytest.approx(0.55 * 0.0001)
    other = got.filter("join_basis = 'point_in_time'").first()
    assert other.cumulative_return == pytest.approx(0.2)


def test_running_sum_is_evaluated_once(frame):
    daily = frame("join_basis:s gics_sector:s trade_date:d mean_return:f", [("naive", "IT", "2020-01-01", 0.1)])
    plan = windows.cumulative_index(daily)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("windowspecdefinition") == 1


def test_per_key_selection(frame, rows):
    df = frame("k:s n:l v:s", [("A", 2, "b"), ("A", 1, "a"), ("B", 7, "x")])
    assert rows(windows.first_per_key(df, "k", "n")) == [("A", 1, "a"), ("B", 7, "x")]
    assert rows(windows.deepest_per_key(df, "k", "n")) == [("A", 2, "b"), ("B", 7, "x")]


def test_log_return(frame):
    prices = frame(PRICES, [("A", "2020-01-01", 10.0), ("A", "2020-01-02", 20.0)])
    assert by_day(windows.returns(prices), "log_return")["2020-01-02"] == pytest.approx(math.log(2))




def test_rows_without_a_key_are_chained_alike_in_both_forms(frame, rows):
    prices = frame(PRICES, [(None, "2020-01-31", 1.0), (None, "2020-02-03", 2.0), (None, "2020-02-04", 3.0), ("A", "2020-02-03", 9.0)])
    plain = windows.previous(prices, "close_price")
    assert rows(windows.previous(prices, "close_price", slice_unit="month")) == rows(plain)
    assert [r.previous for r in plain.filter("ticker IS NULL").orderBy("trade_date").collect()] == [None, 1.0, 2.0]
