import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from chronoframe import sources
from chronoframe.model import DAILY_PRICES, EXCLUDED_ENTITIES, SourceError
from chronoframe.sinks import analyze, create_namespaces, export_frame, materialise, replace_table

HEADER = "Price,Close,High,Low,Open,Volume\nTicker,{t},{t},{t},{t},{t}\nDate,,,,,\n"


def write(folder, name, text):
    (folder / name).write_text(text)


def price_file(folder, ticker, body):
    write(folder, f"{ticker}.csv", HEADER.format(t=ticker) + body)


def test_three_line_header_and_key_from_the_file_name(spark, tmp_path, rows):
    price_file(tmp_path, "OAK", "2011-05-09,7.25,8.5,6.75,7.0,420\n2011-05-10,7.5,7.75,7.125,7.25,35.0\n")
    price_file(tmp_path, "ELM-X+1", "2011-05-09,3.5,4.0,3.0,,\n\n")
    landed = sources.read_keyed_csv(spark, str(tmp_path))
    assert landed.rejects.isEmpty()
    assert landed.rows.columns == [f.name for f in DAILY_PRICES.fields]
    assert dict(landed.rows.dtypes)["volume"] == "bigint"
    assert rows(landed.rows, "ticker", "trade_date", "open_price", "close_price", "volume") == sorted([
        ("OAK", date(2011, 5, 9), 7.0, 7.25, 420),
        ("OAK", date(2011, 5, 10), 7.25, 7.5, 35),
        ("ELM-X+1", date(2011, 5, 9), None, 3.5, None),
    ], key=repr)
    assert rows(sources.corpus_profile(landed.rows)) == [(3, 2, date(2011, 5, 9), date(2011, 5, 10))]


def test_unreadable_files_are_set_aside_whole(spark, tmp_path, rows):
    price_file(tmp_path, "GOOD", "2020-01-02,1.0,1.0,1.0,1.0,10\n")
    write(tmp_path, "LEAN.csv", "Price,Open,Volume\n2011-05-09,4.5,12\n")
    write(tmp_path, "QUOTED.csv", HEADER.format(t="Q") + '"2011-05-09","2.5",2.5,2.5,2.5,"1,250"\n')
    write(tmp_path, "TWICE.csv", HEADER.format(t="T") + "Ticker,T,T,T,T,T\n2011-05-09,1,1,1,1,1\n")
    write(tmp_path, "WIDE.csv", HEADER.format(t="W") + "2011-05-09,1,1,1,1,1,1\n")
    write(tmp_path, "HEADS.csv", HEADER.format(t="H") + "Price,Close,High,Low,Open,Volume\n2011-05-09,1,1,1,1,1\n")
    price_file(tmp_path, "BADDAY", "2020-01-02,1.0,1.0,1.0,1.0,10\nsoon,1.0,1.0,1.0,1.0,10\n")
    price_file(tmp_path, "HALF", "2020-01-02,1.0,1.0,1.0,1.0,10.5\n")
    price_file(tmp_path, "WORD", "2020-01-02,abc,1.0,1.0,1.0,10\n")
    write(tmp_path, "EMPTY.csv", "")
    landed = sources.read_keyed_csv(spark, str(tmp_path))
    assert rows(landed.rows, "ticker") == [("GOOD",)]
    rejects = {r.file: r.reason for r in landed.rejects.collect()}
    assert rejects["LEAN.csv"] == "missing expected columns [Close, High, Low]"
    assert rejects["BADDAY.csv"] == "unusable: 1 dates"
    assert rejects["HALF.csv"] == rejects["WORD.csv"] == rejects["QUOTED.csv"] == "unusable: 1 numbers"
    assert rejects["TWICE.csv"] == "unusable: 1 Ticker lines" and rejects["WIDE.csv"] == "unusable: 1 lines of other length"
    assert rejects["HEADS.csv"] == "unusable: 1 headers"
    assert rejects["EMPTY.csv"] == "missing expected columns [Close, High, Low, Open, Price, Volume]"
    assert len(rejects) == 9


def test_files_may_order_their_columns_differently(spark, tmp_path, rows):
    price_file(tmp_path, "A", "2020-01-02,1.0,2.0,3.0,4.0,5\n")
    write(tmp_path, "B.csv", "Price,Volume,Open,Low,High,Close\nTicker,B,B,B,B,B\nDate,,,,,\n2020-01-02,5,4.0,3.0,2.0,1.0\n")
    landed = sources.read_keyed_csv(spark, str(tmp_path))
    assert rows(landed.rows, "ticker", "close_price", "high_price", "low_price", "open_price", "volume") == [
        ("A", 1.0, 2.0, 3.0, 4.0, 5), ("B", 1.0, 2.0, 3.0, 4.0, 5),
    ]


def test_nothing_to_read_is_an_error(spark, tmp_path):
    with pytest.raises(SourceError, match="no CSV files"):
        sources.read_keyed_csv(spark, str(tmp_path))
    write(tmp_path, "N.csv", "Price,Close\n2020-01-02,1.0\n")
    with pytest.raises(SourceError, match="every file"):
        sources.read_keyed_csv(spark, str(tmp_path))


def test_snapshot(spark, tmp_path):
    write(tmp_path, "snapshot.csv",
          "Symbol,Security,GICS Sector,GICS Sub-Industry,Headquarters Location,Date added,CIK,Founded\n"
          'BRK.B,Berkshire,Financials,"Multi-Sector, Holdings",Omaha,2010-02-16,1067983,1839\n'
          "AAPL,Apple,Information Technology,Hardware,Cupertino,not a day,320193.0,1888 (1969)\n"
          "NOID,None,,,,,,\n")
    got = {r.ticker: r for r in sources.read_snapshot(spark, str(tmp_path / "snapshot.csv")).collect()}
    assert got["BRK.B"].gics_sub_industry == "Multi-Sector, Holdings"
    assert got["BRK.B"].date_added == date(2010, 2, 16)
    assert (got["AAPL"].cik, got["AAPL"].date_added, got["AAPL"].founded) == ("0000320193", None, "1888 (1969)")
    assert (got["NOID"].cik, got["NOID"].gics_sector) == (None, None)


LOG_HEADER = (
    "ticker,company_name,change_type,old_gics_sector,new_gics_sector,old_gics_sub_industry,"
    "new_gics_sub_industry,effective_after_close,first_trading_day,source_id\n"
)


def test_change_log(spark, tmp_path, rows):
    path = tmp_path / "log.csv"
    path.write_text(LOG_HEADER + "ELM,Elm Works,reclassification,Timber,Paper,,,2004-03-12,2004-03-15,note 7\n")
    log = sources.read_change_log(spark, str(path))
    assert rows(log, "ticker", "effective_after_close", "first_trading_day", "old_gics_sub_industry") == [
        ("ELM", date(2004, 3, 12), date(2004, 3, 15), None)
    ]
    path.write_text(LOG_HEADER + "".join(f"K{k:02},x,reclassification,Paper,Paper,,,2004-03-12,2004-03-15,n\n" for k in range(30)))
    with pytest.raises(SourceError, match="30 events leave their label as it was, for instance of K00"):
        sources.read_change_log(spark, str(path))
    path.write_text(LOG_HEADER + "OAK,Oak,reclassification,Timber,Paper,,,some day,2004-03-15,n\n")
    with pytest.raises(Exception, match="not a date: some day"):
        sources.read_change_log(spark, str(path)).collect()


def test_registry_holdouts_and_missing_columns(spark, tmp_path, rows):
    registry, held = tmp_path / "registry.csv", tmp_path / "held.csv"
    registry.write_text("gics_sector,existed_from,existed_to,source_id,notes\nEnergy,1900-01-01,,S9,n\nTel,1900-01-01,2018-09-21,S1,\n")
    assert rows(sources.read_registry(spark, str(registry)), "gics_sector", "existed_to") == [
        ("Energy", None), ("Tel", date(2018, 9, 21))
    ]
    held.write_text("ticker,company_name,exclusion_class,exclusion_reason\nWBD,W,entity_discontinuity,\"formed, 2022\"\n")
    expected = [("WBD", "W", "entity_discontinuity", "formed, 2022")]
    assert rows(sources.read_holdouts(spark, str(held))) == expected
    assert rows(sources.read_seed(spark, str(held), EXCLUDED_ENTITIES)) == expected
    held.write_text("ticker,company_name\nWBD,W\n")
    with pytest.raises(SourceError, match="exclusion_class"):
        sources.read_holdouts(spark, str(held))


def test_intervals_without_a_start_are_dropped_and_counted(spark, tmp_path, rows):
    path = tmp_path / "members.csv"
    path.write_text("ticker,start_date,end_date\nAAL,1996-01-02,1997-01-15\nAAL,2015-03-23,\nX,,2001-01-01\n")
    intervals, dropped = sources.read_intervals(spark, str(path))
    assert rows(intervals) == sorted([("AAL", date(1996, 1, 2), date(1997, 1, 15)), ("AAL", date(2015, 3, 23), None)], key=repr)
    assert dropped.get["dropped"] == 1


def test_missing_parquet_is_named(spark, tmp_path):
    with pytest.raises(SourceError, match="nowhere"):
        sources.read_table(spark, str(tmp_path / "nowhere"))


def test_replacing_a_table_from_itself_and_surviving_a_failed_load(spark, rows):
    create_namespaces(spark)
    replace_table(spark.range(3), "silver.numbers")
    replace_table(spark.table("silver.numbers").selectExpr("id + 10 AS id"), "silver.numbers")
    assert rows(spark.table("silver.numbers")) == [(10,), (11,), (12,)]
    with pytest.raises(Exception, match="broken load"):
        replace_table(spark.range(2).selectExpr("id", "raise_error('broken load') AS x"), "silver.numbers")
    assert rows(spark.table("silver.numbers")) == [(10,), (11,), (12,)]
    leftovers = [t.name for t in spark.catalog.listTables("silver") if "numbers" in t.name]
    assert leftovers == ["numbers"]
    analyze(spark, "silver.numbers", columns=True)


def test_a_swap_that_fails_half_way_gives_the_old_table_back(spark, rows, monkeypatch):
    from chronoframe.sinks import tables

    create_namespaces(spark)
    replace_table(spark.range(2), "silver.swapped")
    plain = tables._rename
    monkeypatch.setattr(tables, "_rename", lambda s, name, to: (_ for _ in ()).throw(OSError("no second rename")) if to == "silver.swapped" and "incoming" in name else plain(s, name, to))
    with pytest.raises(OSError, match="second rename"):
        replace_table(spark.range(5).selectExpr("id", "1 AS more"), "silver.swapped")  # other columns: by renaming
    assert rows(spark.table("silver.swapped")) == [(0,), (1,)]
    assert [t.name for t in spark.catalog.listTables("silver") if "swapped" in t.name] == ["swapped"]


def test_bucketed_tables_join_and_window_without_a_shuffle(spark, frame):
    from chronoframe.operators import joins, windows

    create_namespaces(spark)
    facts = frame("ticker:s trade_date:d close_price:f", [("A", "2020-01-01", 1.0), ("A", "2020-01-02", 2.0)])
    dim = frame("ticker:s gics_sector:s valid_from:d valid_to:d", [("A", "x", "1900-01-01", None)])
    how = {"bucket_by": ("ticker",), "buckets": 4}
    replace_table(facts, "silver.f_bucketed", sort_by=("ticker", "trade_date"), **how)
    replace_table(dim, "silver.d_bucketed", sort_by=("ticker", "valid_from"), **how)
    f, d = spark.table("silver.f_bucketed"), spark.table("silver.d_bucketed")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = joins.pit_join(windows.returns(f), d)
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert joined.count() == 2


def test_export_counts_while_writing(spark, tmp_path):
    path = str(tmp_path / "out.parquet")
    assert export_frame(spark.range(7), path) == 7
    assert any("zstd" in name for name in os.listdir(path))
    assert sources.read_table(spark, path).count() == 7
    assert materialise(spark.range(2), "silver.diagnostic").count() == 2


def test_comments_travel_with_the_table(spark, frame):
    replace_table(frame("ticker:s valid_from:d", [("A", "2020-01-01")]), "silver.dim_sector_scd")
    described = {r.col_name: r.comment for r in spark.sql("DESCRIBE silver.dim_sector_scd").collect()}
    assert described["valid_from"].startswith("First day in force")
    spark.sql("DROP TABLE silver.dim_sector_scd")


def test_a_reader_always_finds_a_table_that_is_replaced(spark):
    """Old rows or new ones, never none: also with a scan planned on the version before."""
    import threading

    create_namespaces(spark)
    replace_table(spark.range(10), "silver.read_on")
    seen, failures, stop = set(), [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                seen.add(spark.table("silver.read_on").count())
            except Exception as error:  # noqa: BLE001
                failures.append(error)

    reader = threading.Thread(target=read)
    reader.start()
    planned = spark.table("silver.read_on")
    for n in (20, 30, 40):
        replace_table(spark.range(n), "silver.read_on")
        if n == 20:
            assert planned.count() == 10
    stop.set()
    reader.join()
    assert not failures and seen <= {10, 20, 30, 40}
    assert spark.table("silver.read_on").count() == 40
    folder = spark.catalog.getDatabase("silver").locationUri.removeprefix("file:")
    assert len([f for f in os.listdir(folder) if f.startswith("read_on__v_")]) == 2
    from chronoframe.sinks import drop_table

    drop_table(spark, "silver.read_on")
    assert not [f for f in os.listdir(folder) if f.startswith("read_on")]


def test_reloading_days_leaves_the_files_of_other_partitions(spark, frame, rows):
    from chronoframe.sinks import reload_partitions

    create_namespaces(spark)
    spec = "ticker:s trade_date:d volume:l month:s"
    replace_table(frame(spec, [("A", "2020-01-05", 1, "2020-01"), ("B", "2020-01-06", 2, "2020-01"), ("A", "2020-02-05", 3, "2020-02")]), "silver.monthly", partition_by=("month",))
    files = lambda: {f for f in spark.table("silver.monthly").inputFiles() if "2020-02" in f}
    before = files()
    reload_partitions(frame(spec, [("A", "2020-01-05", 9, "2020-01"), ("C", "2020-03-01", 4, "2020-03")]), "silver.monthly", key=("ticker", "trade_date"), partition="month")
    assert files() == before
    assert rows(spark.table("silver.monthly"), "ticker", "volume", "month") == [("A", 3, "2020-02"), ("A", 9, "2020-01"), ("B", 2, "2020-01"), ("C", 4, "2020-03")]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
    reload_partitions(frame(spec, []), "silver.monthly", key=("ticker",), partition="month")


def test_statistics_change_the_order_of_joins(spark):
    """Two dimensions: the one whose filter leaves little is joined first once its values are known."""
    create_namespaces(spark)
    replace_table(spark.range(20_000).selectExpr("id", "id % 1000 AS a", "id % 997 AS b"), "silver.cbo_fact")
    replace_table(spark.range(1000).selectExpr("id AS a", "id % 2 AS kind"), "silver.cbo_wide")
    replace_table(spark.range(997).selectExpr("id AS b", "id AS kind"), "silver.cbo_narrow")
    sql = "SELECT count(*) FROM silver.cbo_fact f JOIN silver.cbo_wide w ON f.a = w.a JOIN silver.cbo_narrow n ON f.b = n.b WHERE w.kind = 1 AND n.kind = 5"
    settings = {"spark.sql.cbo.enabled": "true", "spark.sql.cbo.joinReorder.enabled": "true", "spark.sql.statistics.histogram.enabled": "true"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        def first_joined():
            plan = spark.sql(sql)._jdf.queryExecution().optimizedPlan().toString()
            # The deeper a table, the earlier it is joined.
            depth = {t: next(len(line) - len(line.lstrip(" :+-|")) for line in plan.splitlines() if f"cbo_{t}" in line) for t in ("wide", "narrow")}
            return max(depth, key=depth.get)

        assert first_joined() == "wide"
        for table in ("cbo_fact", "cbo_wide", "cbo_narrow"):
            analyze(spark, f"silver.{table}", columns=True)
        assert first_joined() == "narrow"
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_lines_that_do_not_fit_a_seed_are_rejects(spark, tmp_path, rows):
    from chronoframe.model import SECTOR_REGISTRY

    path = tmp_path / "registry.csv"
    path.write_text('\ufeffgics_sector,existed_from,existed_to,source_id,notes\r\nIT,1900-01-01,,S1,"a, ""b"""\r\n\nEN,never,,S1,\nFI,1900-01-01,,S1\n,1900-01-01,,S1,x\n')
    landed = sources.land_seed(spark, str(path), SECTOR_REGISTRY)
    assert rows(landed.rows, "gics_sector", "existed_from", "existed_to", "notes") == [("IT", date(1900, 1, 1), None, 'a, "b"')]
    assert rows(landed.rejects, "reason") == [("cells do not fit the columns",), ("cells do not fit the columns",), ("empty: gics_sector",)]
    path.write_text("gics_sector,notes\nIT,x\n")
    with pytest.raises(SourceError, match="existed_from"):
        sources.land_seed(spark, str(path), SECTOR_REGISTRY)
    path.write_text("")
    with pytest.raises(SourceError, match="gics_sector"):
        sources.land_seed(spark, str(path), SECTOR_REGISTRY)


def test_a_file_in_many_pieces_is_judged_as_one(spark, tmp_path, rows):
    head = ["Price,Close,High,Low,Open,Volume", "Ticker,x,x,x,x,x", "Date,,,,,"]
    lines = [("A.csv", h) for h in head] + [("A.csv", f"2020-01-{d:02},1,1,1,\"1\",5") for d in range(1, 29)]
    lines += [("B.csv", h) for h in head] + [("B.csv", "2020-01-01,1,1,1,1,5"), ("B.csv", "2020-01-02,one,1,1,1,5")]
    spark.createDataFrame(lines, "file string, value string").repartition(7).write.partitionBy("file").text(str(tmp_path / "pieces"))
    landed = sources.read_keyed_csv(spark, str(tmp_path / "pieces"))
    assert rows(landed.rows.groupBy("ticker").count()) == [("A", 28)]
    assert rows(landed.rejects) == [("B.csv", "unusable: 1 numbers")]
    assert "Window" not in landed.rows._jdf.queryExecution().executedPlan().toString()


def test_cells_are_split_in_one_pass(spark):
    from chronoframe.sources.prices import _cells

    texts = ['a,b', ',', 'a,', '"x,y",z', '"q""r",', ' "s" , t', 'open"ed,u', '"never closed,v', '', "x" * 20_000 + "," + '"' + "y,z" * 5_000 + '"']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "line string").select(_cells(F.col("line"))).collect()]
    assert got[:9] == [["a", "b"], ["", ""], ["a", ""], ["x,y", "z"], ['q"r', ""], ["s", "t"], ['open"ed', "u"], ['"never closed', "v"], [""]]
    assert [len(c) for c in got[9]] == [20_000, 15_000]


def test_lines_are_taken_apart_once(spark, tmp_path):
    """Rows and rejects come from stored values; cells are the same with and without quotes, a mark at the start aside."""
    head = ["﻿Price,Close,High,Low,Open,Volume", "Ticker,x,x,x,x,x", "Date,,,,,"]
    lines = [("A.csv", v) for v in [*head, '2020-01-02,"1.5",2,1,,7', " 2020-01-03 , 1.5 ,2,1,NaN,7"]]
    lines += [("B.csv", v) for v in [*head, '2020-01-02,1.5,2,1,"x"",",7']] + [("C.csv", "2020-01-02,1.5,2,1,1,7")]
    lines += [("D.csv", v) for v in ['"Price","Close","High","Low","Open"', '"2020-01-02",Price', "2020-01-02,1,1,1,1"]]
    spark.createDataFrame(lines, "file string, value string").write.parquet(str(tmp_path / "lines"))
    landed = sources.parse_lines(spark.read.parquet(str(tmp_path / "lines")))
    got = sorted((r.ticker, str(r.trade_date), r.open_price, r.close_price, r.volume) for r in landed.rows.collect())
    assert got == [("A", "2020-01-02", None, 1.5, 7), ("A", "2020-01-03", None, 1.5, 7)]
    everything = "missing expected columns [Close, High, Low, Open, Price, Volume]"
    assert {r.file: r.reason for r in landed.rejects.collect()} == {"B.csv": "unusable: 1 numbers", "C.csv": everything, "D.csv": "missing expected columns [Volume]"}
    for df in (landed.rows, landed.rejects):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert str(tmp_path / "lines") not in plan and "regexp_extract_all" not in plan


def test_lines_of_prices_take_the_prices_once(spark, tmp_path):
    from queries.landing import price_lines

    spark.sql("SELECT id % 30 AS ticker, date_add(DATE '2020-01-01', CAST(id AS INT)) AS trade_date, 1.5D AS close_price, id AS volume FROM range(90)").write.parquet(str(tmp_path / "p"))
    lines = price_lines(spark.read.parquet(str(tmp_path / "p")))
    assert lines._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    files = {}
    for r in lines.collect():
        files.setdefault(r.file, []).append(r.value)
    assert len(files) == 30 and all(len(v) == 3 + {3: 4, 5: 1}.get(int(k[1:-4]) % 11, 3) for k, v in files.items())
    assert sum(v.count("Price,Close,High,Low,Open,Volume") for v in files.values()) == 27
    assert sorted(files["C2.csv"])[:3] == ['2020-01-03,"1.5",1.5,1.5,NA,2,9', '2020-02-02,"1.5",1.5,1.5,NA,32', '2020-03-03,"1.5",1.5,1.5,NA,62']
