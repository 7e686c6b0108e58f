"""The layers end to end, from source files to exports, on a small corpus."""

from datetime import date, datetime

import pytest

from chronoframe import sources
from chronoframe.model import IntegrityError, ReportingWindow
from chronoframe.plans import suite, warehouse
from chronoframe.plans.reports import table_counts
from chronoframe.sinks import export_all

W = ReportingWindow.of("2018-09-01", "2018-10-31")
DAYS = ["2018-09-20", "2018-09-21", "2018-09-24", "2018-09-25"]
CLOSES = {
    "GOOGL": [100, 110, 99, 108.9], "MSFT": [50, 55, 60.5, 66.55], "BRK-B": [10, 11, 12.1, 13.31],
    "GONE": [1, 1, 1, 1], "HELD": [2, 2, 2, 2],
}


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    prices = folder / "prices"
    prices.mkdir()
    for ticker, closes in CLOSES.items():
        lines = [f"{d},{c},{c},{c},{c},100" for d, c in zip(DAYS, closes)]
        (prices / f"{ticker}.csv").write_text(
            "Price,Close,High,Low,Open,Volume\n" + f"Ticker{(',' + ticker) * 5}\nDate,,,,,\n" + "\n".join(lines) + "\n"
        )
    (folder / "snapshot.csv").write_text(
        "Symbol,Security,GICS Sector,GICS Sub-Industry,Headquarters Location,Date added,CIK,Founded\n"
        "GOOGL,Alphabet,Communication Services,Media,MV,2014-04-03,1652044,1998\n"
        "MSFT,Microsoft,Information Technology,Software,R,1994-06-01,789019,1975\n"
        "BRK.B,Berkshire,Financials,Holdings,O,2010-02-16,1067983,1839\n"
        "NEW,New,Energy,Oil,H,2025-01-01,1,2020\n"
        "HELD,Held,Financials,Banks,N,2000-01-01,2,1900\n"
    )
    (folder / "log.csv").write_text(
        "ticker,company_name,change_type,old_gics_sector,new_gics_sector,old_gics_sub_industry,"
        "new_gics_sub_industry,effective_after_close,first_trading_day,source_id\n"
        "GOOGL,Alphabet,reclassification,Information Technology,Communication Services,,Media,2018-09-21,2018-09-24,S1\n"
        "TWTR,Twitter,reclassification,Information Technology,Communication Services,,,2018-09-21,2018-09-24,S1\n"
    )
    (folder / "registry.csv").write_text(
        "gics_sector,existed_from,existed_to,source_id,notes\n"
        "Communication Services,2018-09-24,,S1,\nInformation Technology,1900-01-01,,S9,\n"
        "Financials,1900-01-01,,S9,\nEnergy,1900-01-01,,S9,\n"
    )
    (folder / "held.csv").write_text(
        "ticker,company_name,exclusion_class,exclusion_reason\nHELD,Held,entity_discontinuity,two companies\n"
    )
    (folder / "members.csv").write_text("ticker,start_date,end_date\nGOOGL,2014-04-03,\n")
    return folder


def load(spark, folder, **how):
    frames = {
        "daily_prices": sources.read_keyed_csv(spark, str(folder / "prices")).rows,
        "current_snapshot": sources.read_snapshot(spark, str(folder / "snapshot.csv")),
        "sector_history": sources.read_change_log(spark, str(folder / "log.csv")),
        "sector_registry": sources.read_registry(spark, str(folder / "registry.csv")),
        "excluded_entities": sources.read_holdouts(spark, str(folder / "held.csv")),
        "membership": sources.read_intervals(spark, str(folder / "members.csv"))[0],
    }
    warehouse.load_bronze(spark, frames, **how)


@pytest.fixture(scope="module")
def built(spark, corpus):
    load(spark, corpus, recreate=True, buckets=4)
    return warehouse.build_all(spark, W, buckets=4, strict=True)


def test_every_table_is_built_and_timed(spark, built, rows):
    assert tuple(built.seconds) == warehouse.BUILT_TABLES
    counts = dict(rows(table_counts({t: spark.table(t) for t in warehouse.BUILT_TABLES})))
    assert counts["silver.ticker_universe"] == 3
    assert counts["silver.dim_sector_scd"] == 4
    assert counts["silver.fact_returns"] == 12 and counts["gold.fact_returns_pit"] == 9
    assert counts["silver.dim_reconciliation"] == counts["silver.sector_existence_violations"] == 0
    assert built.warnings.isEmpty() and built.total_seconds > 0


def test_universe_and_ledger(spark, built, rows):
    assert rows(spark.table("silver.ticker_universe"), "ticker", "snapshot_ticker", "trading_days") == [
        ("BRK-B", "BRK.B", 4), ("GOOGL", "GOOGL", 4), ("MSFT", "MSFT", 4)
    ]
    assert rows(spark.table("silver.excluded_tickers"), "ticker", "present_in") == [
        ("GONE", "prices_only"), ("HELD", "held_out:entity_discontinuity"), ("NEW", "snapshot_only")
    ]


def test_headline(spark, built):
    anchor = {r.gics_sector: r for r in spark.table("gold.anchor_metric").collect()}
    it, com = anchor["Information Technology"], anchor["Communication Services"]
    # Naive files GOOGL under its later label; on the 21st it still belonged to the old one.
    assert it.naive_cumulative_return == pytest.approx(100 * (1.1**3 - 1))
    assert it.pit_cumulative_return == pytest.approx(100 * (1.1**3 - 1))
    assert com.comparison_start == date(2018, 9, 24)
    assert com.naive_full_window_return == pytest.approx(100 * (1.1 * 0.9 * 1.1 - 1))
    assert com.naive_cumulative_return == pytest.approx(100 * (0.9 * 1.1 - 1))
    assert (com.trading_days_sector_absent, com.misattributed_observations) == (1, 1)


def test_suite_passes_on_a_healthy_warehouse(spark, built):
    result = suite.run(spark)
    assert result.filter("status = 'fail'").collect() == []
    assert result.count() == len(suite.warehouse_checks(spark)) >= 35
    assert {r.check_name for r in result.collect()} == set(suite.warehouse_checks(spark))


def test_one_layer_can_be_rebuilt(spark, built, corpus):
    again = warehouse.build_all(spark, W, only=("gold",), buckets=4)
    assert set(again.seconds) == {t for t in warehouse.BUILT_TABLES if t.startswith("gold.")}
    with pytest.raises(ValueError, match="platinum"):
        warehouse.build_all(spark, W, only=("platinum",), buckets=4)


def test_selected_tables_can_be_reloaded(spark, built, corpus):
    load(spark, corpus, tables=("current_snapshot",))
    assert spark.table("bronze.daily_prices").count() == 20


def test_a_build_goes_on_where_rows_have_changed(spark, built, corpus, frame):
    warehouse.build_all(spark, W, buckets=4)
    assert warehouse.build_all(spark, W, buckets=4, resume=True).seconds == {}
    load(spark, corpus, buckets=4)  # the same rows again
    assert warehouse.build_all(spark, W, buckets=4, resume=True).seconds == {}
    other = ReportingWindow.of("2018-09-01", "2018-12-31")
    assert list(warehouse.build_all(spark, other, buckets=4, resume=True).seconds) == [
        "silver.sector_existence_violations", "gold.sector_daily_returns", "gold.anchor_metric"
    ]  # the daily rows are the same, so what is built of them alone stays
    held = frame("ticker:s company_name:s exclusion_class:s exclusion_reason:s", [("HELD", "Held", "entity_discontinuity", "still two companies")])
    warehouse.load_bronze(spark, {"excluded_entities": held})
    again = warehouse.build_all(spark, other, buckets=4, resume=True)
    assert list(again.seconds) == ["silver.ticker_universe", "silver.excluded_tickers"]
    warehouse.load_bronze(spark, {"excluded_entities": held.limit(0)})
    again = warehouse.build_all(spark, other, buckets=4, resume=True)
    assert tuple(again.seconds) == warehouse.BUILT_TABLES  # another universe: everything reads it in the end
    spark.sql("DROP TABLE gold.sector_daily_returns")
    assert "gold.sector_daily_returns" in warehouse.build_all(spark, other, buckets=4, resume=True).seconds
    load(spark, corpus, buckets=4)
    warehouse.build_all(spark, W, buckets=4, resume=True)


def test_a_table_whose_check_failed_is_built_again(spark, built, corpus):
    log = spark.table("bronze.sector_history")
    doubled = log.unionByName(log)
    doubled.createOrReplaceTempView("doubled")
    warehouse.load_bronze(spark, {"sector_history": spark.createDataFrame(doubled.toPandas(), log.schema)})
    for _ in range(2):
        with pytest.raises(IntegrityError, match="repeated change events"):
            warehouse.build_all(spark, W, buckets=4, resume=True)
    load(spark, corpus, tables=("sector_history",))
    assert "silver.stg_sector_events" in warehouse.build_all(spark, W, buckets=4, resume=True).seconds


def test_exports(spark, built, tmp_path):
    exported = export_all(spark, str(tmp_path))
    assert exported["dim_sector_scd.parquet"] == 4 and exported["excluded_tickers.parquet"] == 3
    assert sources.read_table(spark, str(tmp_path / "anchor_metric.parquet")).count() == exported["anchor_metric.parquet"]


def test_strict_build_stops_before_gold(spark, built, corpus):
    """Without the change log the snapshot's label is claimed before it existed."""
    spark.table("bronze.sector_history").limit(0).createOrReplaceTempView("no_changes")
    try:
        warehouse.load_bronze(spark, {"sector_history": spark.table("no_changes")})
        with pytest.raises(IntegrityError):
            warehouse.build_all(spark, W, buckets=4, strict=True)
    finally:
        load(spark, corpus, tables=("sector_history",))
        warehouse.build_all(spark, W, only=("silver",), buckets=4)


def test_streamed_snapshot_tracking(spark, frame, tmp_path, rows):
    from chronoframe.streaming import track

    source = "ticker:s current_gics_sector:s current_sub_industry:s seen:l"
    arrivals, checkpoint = str(tmp_path / "arrivals"), str(tmp_path / "progress")
    frame(source, [("A", "IT", "x", 1), ("B", "IT", "y", 1)]).write.parquet(arrivals)
    schema = spark.read.parquet(arrivals).schema

    def run(day):
        stream = spark.readStream.schema(schema).parquet(arrivals)
        query = track(
            stream, "silver.tracked", checkpoint, clock=lambda: datetime(2024, 1, day), order="seen"
        )
        assert query.awaitTermination(60)

    run(1)
    frame(source, [("A", "FIN", "x", 2), ("A", "CS", "x", 3), ("C", "EN", "z", 2)]).write.mode("append").parquet(arrivals)
    run(8)
    run(9)  # nothing new arrived
    assert rows(spark.table("silver.tracked"), "ticker", "current_gics_sector", "valid_from", "valid_to") == sorted([
        ("A", "IT", datetime(2024, 1, 1), datetime(2024, 1, 8)), ("A", "CS", datetime(2024, 1, 8), None),
        ("B", "IT", datetime(2024, 1, 1), None), ("C", "EN", datetime(2024, 1, 8), None),
    ], key=repr)
    spark.sql("DROP TABLE silver.tracked")


def test_a_tracker_writes_closed_rows_once(spark, frame, tmp_path, rows):
    import os

    from chronoframe.model import SourceError
    from chronoframe.streaming import Tracker

    source = "ticker:s current_gics_sector:s current_sub_industry:s seen:l"
    tracker = Tracker(spark, str(tmp_path / "tracked"))
    with pytest.raises(SourceError, match="nothing has been tracked"):
        tracker.rows()
    arrivals, checkpoint = str(tmp_path / "arrivals"), str(tmp_path / "progress")

    def run(day, *states):
        if states:
            frame(source, states).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(frame(source, []).schema).parquet(arrivals)
        assert tracker.run(stream, checkpoint, order="seen", clock=lambda: datetime(2024, 1, day)).awaitTermination(60) is not False

    def files(part):
        return sorted(f"{at}/{f}" for at, _, names in os.walk(tmp_path / "tracked") for f in names if f"part={part}" in at and f.endswith(".parquet"))

    run(1, ("A", "IT", "x", 1), ("B", "IT", "y", 1))
    run(8, ("A", "FIN", "x", 2), ("A", "CS", "x", 3), ("C", "EN", "z", 2))
    closed = files("closed")
    run(9)  # nothing new arrived
    assert tracker.batches() == [0, 1] and files("closed") == closed
    run(15, ("B", "FIN", "y", 4))
    run(22, ("C", "IT", "z", 5))
    assert set(closed) < set(files("closed")) and len({f.partition("batch=")[2][0] for f in files("open")}) == 2
    expected = sorted([
        ("A", "IT", datetime(2024, 1, 1), datetime(2024, 1, 8)), ("A", "CS", datetime(2024, 1, 8), None),
        ("B", "IT", datetime(2024, 1, 1), datetime(2024, 1, 15)), ("B", "FIN", datetime(2024, 1, 15), None),
        ("C", "EN", datetime(2024, 1, 8), datetime(2024, 1, 22)), ("C", "IT", datetime(2024, 1, 22), None),
    ], key=repr)
    columns = ("ticker", "current_gics_sector", "valid_from", "valid_to")
    assert rows(tracker.rows(), *columns) == expected
    # A batch delivered twice changes nothing; one that was cut off before its end is not seen, and is written again.
    tracker.fold(frame(source, [("A", "XX", "x", 9)]), 3, datetime(2024, 2, 1), "seen")
    assert rows(tracker.rows(), *columns) == expected
    half = tmp_path / "tracked" / "batch=4" / "part=closed"
    half.mkdir(parents=True)
    frame(source, []).write.mode("overwrite").parquet(str(half))
    (half / "_SUCCESS").unlink()
    assert rows(tracker.rows(), *columns) == expected
    tracker.fold(frame(source, [("A", "XX", "x", 9)]), 4, datetime(2024, 2, 1), "seen")
    assert len(rows(tracker.rows())) == 7 and tracker.batches()[-1] == 4


def test_buckets_grow_with_the_prices(spark, monkeypatch):
    """The task that sorts a bucket holds as much however many prices there are."""
    import __spark_entry__ as contract

    assert [warehouse.buckets_for(n) for n in (0, 4_000_000, 4_000_001, 216_000_000)] == [4, 4, 5, 216]
    lines = spark.read.parquet(f"{contract.SMOKE_DIR}/lineitem.parquet").count()
    monkeypatch.setattr(warehouse, "BUCKET_ROWS", 1000)
    contract.queries()["built_anchor"](spark, contract.SMOKE_DIR)
    for name in ("bronze.daily_prices", "silver.fact_returns", "silver.dim_sector_scd"):
        facts = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE FORMATTED {name}").collect()}
        assert int(facts["Num Buckets"]) == -(-lines // 1000) > 4
