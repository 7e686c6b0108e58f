from datetime import date

import pytest

from chronoframe.operators import joins

DIM = "ticker:s gics_sector:s valid_from:d valid_to:d is_current:b version_number:i"


@pytest.fixture
def dim(frame):
    return frame(
        DIM,
        [
            ("G", "IT", "1900-01-01", "2018-09-21", False, 1),
            ("G", "CS", "2018-09-24", None, True, 2),
            ("M", "IT", "1900-01-01", None, True, 1),
        ],
    )


@pytest.fixture
def facts(frame):
    return frame(
        "ticker:s trade_date:d daily_return:f",
        [
            ("G", "2018-09-20", None),
            ("G", "2018-09-21", 0.01),
            ("G", "2018-09-22", 0.02),
            ("G", "2018-09-24", 0.03),
            ("M", "2018-09-24", 0.04),
            ("X", "2018-09-24", 0.05),
        ],
    )


@pytest.mark.parametrize("strategy", joins.STRATEGIES)
def test_both_interval_ends_are_inclusive(facts, dim, rows, strategy):
    joined = joins.pit_join(facts, dim, strategy=strategy, slice_unit="month")
    assert rows(joined, "ticker", "trade_date", "gics_sector") == [
        ("G", date(2018, 9, 20), "IT"),
        ("G", date(2018, 9, 21), "IT"),
        ("G", date(2018, 9, 24), "CS"),
        ("M", date(2018, 9, 24), "IT"),
    ]


@pytest.mark.parametrize("strategy", joins.STRATEGIES)
def test_left_join_keeps_facts_in_gaps_and_of_unknown_keys(facts, dim, rows, strategy):
    joined = joins.pit_join(facts, dim, how="left", strategy=strategy)
    assert joined.count() == 6
    lost = joined.filter("gics_sector IS NULL")
    assert rows(lost, "ticker", "trade_date") == [("G", date(2018, 9, 22)), ("X", date(2018, 9, 24))]


def test_unknown_strategy_is_refused(facts, dim):
    with pytest.raises(ValueError, match="strategy"):
        joins.pit_join(facts, dim, strategy="guess")


@pytest.mark.parametrize("strategy", joins.STRATEGIES)
def test_dual_label(facts, dim, rows, strategy):
    labelled = joins.dual_label(facts, dim, strategy=strategy)
    assert rows(labelled, "ticker", "trade_date", "sector_at_trade_date", "sector_today", "is_misattributed") == [
        ("G", date(2018, 9, 21), "IT", "CS", True),
        ("G", date(2018, 9, 24), "CS", "CS", False),
        ("M", date(2018, 9, 24), "IT", "IT", False),
    ]


def test_naive_join_uses_todays_label_for_every_day(facts, dim, rows):
    joined = joins.naive_join(facts, dim).filter("ticker = 'G'")
    assert rows(joined.select("gics_sector").distinct()) == [("CS",)]


def test_nothing_is_broadcast_beyond_the_threshold(spark, facts, dim):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for strategy in ("range", "sliced"):
            plan = joins.dual_label(facts, dim, strategy=strategy)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan
            assert "Broadcast" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sliced_join_puts_the_slice_into_the_equi_key(spark, facts, dim):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joins.pit_join(facts, dim, strategy="sliced")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = next(line for line in plan.splitlines() if "SortMergeJoin" in line)
    assert "_fact_slice" in join.split("],")[0]


def test_lookup(dim, rows, frame):
    assert rows(joins.lookup(dim, "G", date(2017, 6, 15))) == [("IT",)]
    assert rows(joins.lookup(dim, "G", date(2018, 9, 22))) == []
    requests = frame("ticker:s as_of:d", [("G", "2017-06-15"), ("G", "2018-09-22"), ("Q", "2020-01-01")])
    assert rows(joins.lookup_many(dim, requests)) == sorted(
        [("G", date(2017, 6, 15), "IT"), ("G", date(2018, 9, 22), None), ("Q", date(2020, 1, 1), None)], key=repr
    )


def test_range_join_count(facts, dim):
    assert joins.range_join_count(facts, dim).first()["joined_rows"] == 4


def test_membership_with_several_intervals(frame, facts, rows):
    intervals = frame(
        "ticker:s start_date:d end_date:d",
        [("G", "2018-09-01", "2018-09-20"), ("G", "2018-09-19", "2018-09-20"), ("G", "2018-09-24", None)],
    )
    members = joins.members_on(facts, intervals)
    assert rows(members, "ticker", "trade_date") == [("G", date(2018, 9, 20)), ("G", date(2018, 9, 24))]


def test_match_counts_see_gaps_and_overlaps(frame, rows):
    broken = frame(
        DIM,
        [
            ("A", "x", "1900-01-01", "2020-01-10", False, 1),
            ("A", "y", "2020-01-09", "2020-01-12", False, 2),
            ("A", "z", "2020-01-20", "2020-01-18", False, 3),
            ("A", "z", "2020-01-15", None, True, 4),
        ],
    )
    facts = frame(
        "ticker:s trade_date:d",
        [("A", d) for d in ("2020-01-08", "2020-01-09", "2020-01-10", "2020-01-11", "2020-01-13", "2020-01-15", "2020-01-19")]
        + [("B", "2020-01-08")],
    )
    got = {(r.ticker, str(r.trade_date)): r.matching_dimension_rows for r in joins.match_counts(facts, broken).collect()}
    assert got == {
        ("A", "2020-01-08"): 1, ("A", "2020-01-09"): 2, ("A", "2020-01-10"): 2, ("A", "2020-01-11"): 1,
        ("A", "2020-01-13"): 0, ("A", "2020-01-15"): 1, ("A", "2020-01-19"): 1, ("B", "2020-01-08"): 0,
    }


def test_mismatches_in_both_directions(frame, rows):
    left, right = frame("ticker:s", [("A",), ("A",), ("B",)]), frame("ticker:s", [("B",), ("C",)])
    assert rows(joins.mismatches(left, right)) == [("A", "left_only"), ("C", "right_only")]


def test_merged_intervals(frame, rows):
    spans = frame(
        "ticker:s start_date:d end_date:d",
        [
            ("A", "2020-01-01", "2020-01-05"), ("A", "2020-01-03", "2020-01-04"), ("A", "2020-01-05", "2020-01-09"),
            ("A", "2020-01-11", "2020-01-12"), ("A", "2020-01-11", "2020-01-11"), ("A", "2020-02-01", None),
            ("A", "2020-03-01", "2020-03-02"), ("B", "2020-01-02", "2020-01-01"),
        ],
    )
    assert rows(joins.merged_intervals(spans)) == [
        ("A", date(2020, 1, 1), date(2020, 1, 9)),
        ("A", date(2020, 1, 11), date(2020, 1, 12)),
        ("A", date(2020, 2, 1), None),
    ]


@pytest.mark.parametrize("strategy", joins.STRATEGIES)
@pytest.mark.parametrize("days", [None, (date(2018, 9, 22), date(2018, 9, 23)), (date(1950, 1, 1), date(1950, 1, 2)), (date(2050, 1, 1), date(2050, 1, 2))])
def test_timestamps_count_by_their_day_and_no_period_loses_facts(frame, dim, rows, strategy, days):
    from datetime import datetime

    stamps = [("G", datetime(2018, 9, 21, 23, 59)), ("G", datetime(2018, 9, 24, 0, 1)), ("G", datetime(2018, 9, 22, 12)), ("M", datetime(1990, 5, 1, 7)), ("M", datetime(2030, 5, 1, 7))]
    facts = frame("ticker:s trade_date:t", stamps)
    joined = joins.pit_join(facts, dim, strategy=strategy, slice_unit="month", days=days)
    assert rows(joined, "ticker", "trade_date", "gics_sector") == sorted([
        ("G", stamps[0][1], "IT"), ("G", stamps[1][1], "CS"), ("M", stamps[3][1], "IT"), ("M", stamps[4][1], "IT"),
    ], key=repr)


def test_timestamps_in_the_other_predicates(frame, dim, rows):
    from datetime import datetime

    from chronoframe.model import ReportingWindow
    from chronoframe.operators import quality, shaping

    facts = frame("ticker:s trade_date:t", [("G", datetime(2018, 9, 21, 18)), ("G", datetime(2018, 9, 23, 18))])
    counts = joins.match_counts(facts, dim)
    assert rows(counts) == [("G", date(2018, 9, 21), 1), ("G", date(2018, 9, 23), 0)]
    assert quality.gap_days(dim, facts).count() == 1
    assert shaping.in_window(facts, "trade_date", ReportingWindow.of("2018-09-01", "2018-09-21")).count() == 1
    members = frame("ticker:s start_date:d end_date:d", [("G", "2018-09-01", "2018-09-21")])
    assert joins.members_on(facts, members).count() == 1
    assert rows(joins.lookup(dim, "G", datetime(2018, 9, 21, 23))) == [("IT",)]


def test_two_current_versions_are_refused(frame, facts):
    dim = frame(DIM, [("G", "x", "1900-01-01", None, True, 1), ("G", "a", "2018-09-21", None, True, 2), ("M", "IT", "1900-01-01", None, True, 1)])
    with pytest.raises(Exception, match="more than one current version of G"):
        joins.dual_label(facts, dim).collect()


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_merge_over_ranges_matches_the_range_join(spark, rows, how, ranges):
    """One key with most rows, days with many facts, gaps, keys on one side only, null keys and days."""
    dim = spark.range(60).selectExpr(
        "IF(id % 3 = 0, concat('K', id % 4), 'HOT') AS ticker", "concat('L', id) AS gics_sector",
        "date_add(DATE '2020-01-01', CAST(id * 5 AS INT)) AS valid_from",
        "IF(id = 59, NULL, date_add(DATE '2020-01-01', CAST(id * 5 + 3 + id % 2 AS INT))) AS valid_to",
    )
    facts = spark.range(900).selectExpr(
        "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 9 = 0 THEN concat('K', id % 6) ELSE 'HOT' END AS ticker",
        "IF(id % 37 = 0, NULL, date_add(DATE '2019-12-15', CAST(IF(id % 2 = 0, 150, id % 380) AS INT))) AS trade_date", "id AS `a.b`",
    )
    merged = joins.pit_join(facts, dim, how=how, strategy="prefix", ranges=ranges)
    assert rows(merged) == rows(joins.pit_join(facts, dim, how=how)) and merged.columns == [*facts.columns, "gics_sector"]


def test_merge_over_ranges_leaves_no_task_to_a_key(spark):
    dim = spark.sql("SELECT 'A' AS ticker, 'x' AS gics_sector, DATE '2020-01-01' AS valid_from, CAST(NULL AS DATE) AS valid_to")
    facts = spark.range(5000).selectExpr("'A' AS ticker", "DATE '2020-06-01' AS trade_date", "id")
    merged = joins.pit_join(facts, dim, strategy="prefix", ranges=8)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_range" in plan and "hashpartitioning(_key" not in plan and "hashpartitioning(ticker" not in plan
    scanned = spark.read.parquet(*{f.rpartition("/")[0] for f in merged.inputFiles()})
    sizes = [r["count"] for r in scanned.groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 5000 / 8 * 2
