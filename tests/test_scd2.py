from datetime import date, datetime

import pytest

from chronoframe.model import IntegrityError, ReportingWindow
from chronoframe.operators import chains, scd2

IT, CS, FIN = "Information Technology", "Communication Services", "Financials"
LOG = (
    "ticker:s change_type:s old_gics_sector:s new_gics_sector:s old_gics_sub_industry:s "
    "new_gics_sub_industry:s effective_after_close:d first_trading_day:d"
)
UNIVERSE = "ticker:s security_name:s current_gics_sector:s current_sub_industry:s"
GOOGL = ("GOOGL", "reclassification", IT, CS, "Internet Software", "Interactive Media", "2018-09-21", "2018-09-24")


@pytest.fixture
def universe(frame):
    return frame(
        UNIVERSE,
        [
            ("GOOGL", "Alphabet", CS, "Interactive Media"),
            ("MSFT", "Microsoft", IT, "Software"),
            ("TWO", "Twice", FIN, "Payments"),
        ],
    )


@pytest.fixture
def log(frame):
    return frame(
        LOG,
        [
            ("TWO", "sector_rename", CS, FIN, "Media", "Payments", "2023-03-17", "2023-03-20"),
            ("TWO", "reclassification", IT, CS, None, "Media", "2018-09-21", "2018-09-24"),
            GOOGL,
            ("TWTR", "reclassification", IT, CS, None, None, "2018-09-21", "2018-09-24"),
        ],
    )


def versions(df, key):
    got = df.filter(df.ticker == key).orderBy("valid_from").collect()
    return [
        (r.gics_sector, r.gics_sub_industry, str(r.valid_from), r.valid_to and str(r.valid_to), r.is_current,
         r.version_number, r.change_reason)
        for r in got
    ]


def test_history_across_a_weekend(universe, log):
    dim = scd2.build_scd2(universe, log)
    assert versions(dim, "GOOGL") == [
        (IT, "Internet Software", "1900-01-01", "2018-09-21", False, 1, "initial"),
        (CS, "Interactive Media", "2018-09-24", None, True, 2, "reclassification"),
    ]


def test_three_versions_from_unsorted_events_keep_unrecorded_history_null(universe, log):
    dim = scd2.build_scd2(universe, log)
    assert versions(dim, "TWO") == [
        (IT, None, "1900-01-01", "2018-09-21", False, 1, "initial"),
        (CS, "Media", "2018-09-24", "2023-03-17", False, 2, "reclassification"),
        (FIN, "Payments", "2023-03-20", None, True, 3, "sector_rename"),
    ]


def test_never_changed_key_has_one_version_with_todays_label(universe, log):
    dim = scd2.build_scd2(universe, log)
    assert versions(dim, "MSFT") == [(IT, "Software", "1900-01-01", None, True, 1, "initial")]


def test_events_outside_the_universe_are_left_out(universe, log, rows):
    dim = scd2.build_scd2(universe, log)
    assert rows(dim.select("ticker").distinct()) == [("GOOGL",), ("MSFT",), ("TWO",)]


def test_single_pass_equals_stepwise_build(universe, log, rows):
    events = scd2.stage_events(log, universe)
    stepwise = scd2.replay(scd2.opening_state(universe, events), events)
    fused = scd2.build_scd2(universe, log)
    assert rows(stepwise, *fused.columns) == rows(fused)


def test_single_pass_has_one_shuffle(universe, log):
    plan = scd2.build_scd2(universe, log)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan


def test_replay_refuses_events_without_an_opening_row(universe, log):
    opening = scd2.opening_state(universe, log)
    with pytest.raises(IntegrityError, match="2018-09-24: closed 2 rows but opened 3"):
        scd2.checked_replay(opening, log)
    balanced = scd2.stage_events(log, universe)
    assert scd2.checked_replay(opening, balanced).count() == 6


def test_surrogate_key_is_stable_and_unique(universe, log, rows):
    first = scd2.with_sector_key(scd2.build_scd2(universe, log))
    again = scd2.with_sector_key(scd2.build_scd2(universe, log).repartition(3))
    assert rows(first) == rows(again)
    assert first.select("sector_key").distinct().count() == 6


def test_reconciliation_finds_what_the_log_missed(universe, log, rows, frame):
    assert scd2.reconcile(scd2.build_scd2(universe, log), universe).isEmpty()
    short = log.filter("first_trading_day < DATE '2020-01-01'")
    found = scd2.reconcile(scd2.build_scd2(universe, short), universe)
    assert rows(found) == [("TWO", "Twice", FIN, CS, 2, date(2018, 9, 24))]


def test_continuity_of_the_log(log, frame, rows):
    assert scd2.broken_continuity(log).isEmpty()
    broken = log.filter("ticker <> 'TWO'").unionByName(
        frame(LOG, [
            ("TWO", "reclassification", IT, CS, None, None, "2018-09-21", "2018-09-24"),
            ("TWO", "reclassification", "Energy", FIN, None, None, "2023-03-17", "2023-03-20"),
        ])
    )
    assert rows(scd2.broken_continuity(broken), "ticker", "expected_old_sector", "old_gics_sector") == [
        ("TWO", CS, "Energy")
    ]


def test_label_lifetimes(universe, log, frame, rows):
    registry = frame(
        "gics_sector:s existed_from:d existed_to:d",
        [(CS, "2018-09-24", None), (IT, "1900-01-01", "2020-12-31"), (FIN, "1900-01-01", None)],
    )
    window = ReportingWindow.of("2016-10-03", "2025-12-19")
    found = scd2.existence_violations(scd2.build_scd2(universe, log), registry, window)
    assert rows(found, "ticker", "gics_sector", "violation") == [
        ("MSFT", IT, "claims sector after it was retired")
    ]
    short = log.filter("ticker <> 'GOOGL'")
    early = scd2.existence_violations(scd2.build_scd2(universe, short), registry, window)
    assert ("GOOGL", CS, "claims sector before it existed") in rows(early, "ticker", "gics_sector", "violation")


def test_calendar_walk_stops_at_the_weekend_and_successor_walk_does_not(universe, log):
    dim = scd2.build_scd2(universe, log)
    strict = chains.chain_calendar(dim, of="GOOGL").collect()
    assert [(r.depth, r.gics_sector, r.valid_to) for r in strict] == [(1, IT, "2018-09-21")]
    tolerant = chains.chain_successor(dim, of="GOOGL").orderBy("depth").collect()
    assert [(r.depth, r.valid_to, r.sector_path) for r in tolerant] == [
        (1, "2018-09-21", IT),
        (2, "current", f"{IT} -> {CS}"),
    ]


def test_all_chains(universe, log, rows):
    dim = scd2.build_scd2(universe, log)
    assert rows(chains.all_chains(dim)) == [
        ("GOOGL", 2, f"{IT} -> {CS}"),
        ("TWO", 3, f"{IT} -> {CS} -> {FIN}"),
    ]


def test_walks_of_long_histories_stay_linear(spark):
    """Every row carries its own and the previous label only; the whole path comes once per key."""
    day = "date_add(DATE '1950-01-01', CAST(id AS INT))"
    dim = spark.range(2000).selectExpr(
        "'A' AS ticker", "concat('label ', id % 7) AS gics_sector", "CAST(NULL AS STRING) AS gics_sub_industry", f"{day} AS valid_from",
        f"IF(id = 1999, NULL, {day}) AS valid_to", "CAST(id + 1 AS INT) AS version_number", "'reclassification' AS change_reason",
    )
    for walk in (chains.chain_successor, chains.chain_calendar):
        got = walk(dim).collect()
        assert [r.depth for r in got] == list(range(1, 2001))
        assert all(r.previous_label == f"label {(r.depth - 2) % 7}" for r in got[1:])
        assert sum(len(str(r)) for r in got) < 600_000
    assert len(chains.all_chains(dim).first().sector_path.split(" -> ")) == 2000


def test_snapshot_check_changed_unchanged_new_and_vanished(frame, rows):
    source = "ticker:s current_gics_sector:s current_sub_industry:s"
    first, second, third = (datetime(2024, 1, d) for d in (1, 8, 15))
    state = scd2.snapshot_start(
        frame(source, [("A", IT, "x"), ("B", IT, None), ("C", FIN, "z")]), first
    )
    # A moves, B keeps a NULL, C vanishes, D is new.
    state = scd2.snapshot_check(state, frame(source, [("A", CS, "x"), ("B", IT, None), ("D", FIN, "q")]), second)
    expected = [
        ("A", CS, second, None), ("A", IT, first, second), ("B", IT, first, None),
        ("C", FIN, first, None), ("D", FIN, second, None),
    ]
    shown = ("ticker", "current_gics_sector", "valid_from", "valid_to")
    assert rows(state, *shown) == sorted(expected, key=repr)
    # The same state again changes nothing; a NULL that becomes a value does.
    state = scd2.snapshot_check(state, frame(source, [("A", CS, "x"), ("B", IT, "y"), ("D", FIN, "q")]), third)
    assert state.count() == 6
    assert state.filter("ticker = 'B' AND valid_to IS NULL").first().current_sub_industry == "y"
