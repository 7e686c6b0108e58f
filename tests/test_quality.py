from datetime import date

import pytest

from chronoframe.model import IntegrityError
from chronoframe.operators import quality as dq

DIM = "ticker:s gics_sector:s valid_from:d valid_to:d is_current:b version_number:i change_reason:s"


@pytest.fixture
def healthy(frame):
    return frame(DIM, [
        ("G", "IT", "1900-01-01", "2018-09-21", False, 1, "initial"),
        ("G", "CS", "2018-09-24", None, True, 2, "reclassification"),
    ])


@pytest.fixture
def facts(frame):
    return frame("ticker:s trade_date:d", [("G", "2018-09-21"), ("G", "2018-09-24")])


def test_a_weekend_is_not_a_gap(healthy, facts):
    for check in (
        dq.overlaps(healthy), dq.current_row_violations(healthy), dq.gap_days(healthy, facts),
        dq.integrity_violations(facts, healthy), dq.scd2_shape(healthy),
    ):
        assert check.isEmpty()


def test_an_observed_day_in_the_last_gap_is_found(healthy, frame, rows):
    saturday = frame("ticker:s trade_date:d", [("G", "2018-09-22"), ("G", "2018-09-24")])
    assert rows(dq.gap_days(healthy, saturday)) == [
        ("G", date(2018, 9, 21), date(2018, 9, 24), date(2018, 9, 22))
    ]
    assert rows(dq.integrity_violations(saturday, healthy)) == [("G", date(2018, 9, 22), 0)]


def test_overlaps_with_equal_starts_and_nested_versions(frame, rows):
    dim = frame(DIM, [
        ("A", "x", "1900-01-01", "2020-01-31", False, 1, "initial"),
        ("A", "y", "2020-01-10", "2020-01-12", False, 2, "reclassification"),
        ("A", "z", "2020-01-20", None, True, 3, "reclassification"),
        ("B", "x", "2020-01-01", "2020-01-05", False, 1, "initial"),
        ("B", "y", "2020-01-01", None, True, 2, "reclassification"),
    ])
    assert rows(dq.overlaps(dim), "ticker", "version_a_from", "version_b_from") == [
        ("A", date(1900, 1, 1), date(2020, 1, 10)),
        ("A", date(1900, 1, 1), date(2020, 1, 20)),
        ("B", date(2020, 1, 1), date(2020, 1, 1)),
    ]


def test_overlap_check_reports_every_offender_of_a_brute_force_search(spark, rows):
    dim = spark.range(300).selectExpr(
        "concat('K', id % 7) AS ticker", "'x' AS gics_sector",
        "date_add(DATE '2020-01-01', CAST((id * 37) % 211 AS INT)) AS valid_from",
        "date_add(DATE '2020-01-01', CAST((id * 37) % 211 + id % 9 AS INT)) AS valid_to",
        "CAST(id AS INT) AS version_number",
    )
    dim.createOrReplaceTempView("brute_dim")
    wanted = spark.sql("""
        SELECT DISTINCT b.ticker, b.valid_from, b.valid_to FROM brute_dim a JOIN brute_dim b ON a.ticker = b.ticker
        WHERE (a.valid_from < b.valid_from OR (a.valid_from = b.valid_from AND a.version_number < b.version_number))
          AND a.valid_to >= b.valid_from""")
    got = dq.overlaps(dim).select("ticker", "version_b_from", "version_b_to").distinct()
    assert rows(got) == rows(wanted) and got.count() > 20


def test_two_current_rows_and_none(frame, rows):
    dim = frame(DIM, [
        ("A", "x", "1900-01-01", None, True, 1, "initial"),
        ("A", "y", "2020-01-01", None, True, 2, "reclassification"),
        ("B", "x", "1900-01-01", "2020-01-01", False, 1, "initial"),
    ])
    assert rows(dq.current_row_violations(dim)) == [("A", 2), ("B", 0)]


def test_row_rules(frame, rows):
    dim = frame(DIM, [
        ("A", "x", "2020-01-02", "2020-01-01", True, 0, "whim"),
        ("B", "x", "2020-01-02", None, True, 1, "initial"),
    ])
    assert rows(dq.scd2_shape(dim), "ticker", "broken_rule") == [
        ("A", "current flag and end disagree"), ("A", "ends before it starts"),
        ("A", "unknown change reason"), ("A", "version below one"),
    ]


def test_unapplied_changes(frame, rows, healthy):
    log = frame("ticker:s first_trading_day:d", [("G", "2018-09-24"), ("H", "2018-09-24"), ("H", "2019-09-24"), ("Z", "2018-09-24")])
    universe = frame("ticker:s", [("G",), ("H",)])
    dim = healthy.unionByName(frame(DIM, [("H", "IT", "1900-01-01", None, True, 1, "initial")]))
    assert rows(dq.unapplied_changes(log, universe, dim)) == [("H", 1)]


def test_generic_checks(frame, rows):
    df = frame("k:s v:l low:d high:d", [("a", 1, "2020-01-01", "2020-01-02"), ("a", None, "2020-01-02", "2020-01-02"), ("b", None, "2020-01-03", "2020-01-02")])
    assert rows(dq.not_null(df, ["k", "v"])) == [("v", 2)]
    assert rows(dq.unique(df, ["k"])) == [("a", 2)]
    assert rows(dq.accepted(df, "k", ["a"])) == [("b", 1)]
    assert dq.ordered(df, "low", "high", strict=True).count() == 2
    assert dq.ordered(df, "low", "high", strict=False).count() == 1
    assert dq.expect_rows(df, 3).isEmpty() and rows(dq.expect_rows(df, 1)) == [(3,)]
    assert rows(dq.group_size_violations(df, ["k"], least=1, most=1)) == [("a", 2)]


def test_suite_and_gate(healthy, frame, rows):
    checks = {"current": dq.current_row_violations(healthy), "starts": dq.unique(healthy, ["ticker"])}
    assert rows(dq.run_suite(checks)) == [("current", 0, "pass"), ("starts", 1, "fail")]
    assert rows(dq.warnings(checks)) == [("starts", 1)]
    dq.assert_empty(checks["current"], "current")
    with pytest.raises(IntegrityError, match="starts"):
        dq.assert_empty(checks["starts"], "starts")


def test_rules_of_a_table_in_one_pass_count_what_each_check_finds(frame, rows):
    table = frame("k:s v:i d:d", [("a", 1, "2020-01-01"), ("a", 1, None), ("b", 2, "2020-01-02"), (None, 3, "2020-01-03"), (None, 3, None), ("c", None, None)])
    rules = {
        "one k": dq.Unique(("k",)), "one k and v": dq.Unique(("k", "v")), "one day": dq.Unique(("d",)), "again": dq.Unique(("k",)),
        "v known": dq.Accepted("v", (1,)), "k known": dq.Accepted("k", ("a", "b", "c")),
        "present": dq.NotNull(("k", "v", "d")), "v present": dq.NotNull(("v",)),
        "small": dq.Rows((table["v"] > 2, table["v"] > 1)),
    }
    found = dict(rows(dq.table_checks(table, rules)))
    alone = {
        "one k": dq.unique(table, ["k"]), "one k and v": dq.unique(table, ["k", "v"]), "one day": dq.unique(table, ["d"]), "again": dq.unique(table, ["k"]),
        "v known": dq.accepted(table, "v", [1]), "k known": dq.accepted(table, "k", ["a", "b", "c"]),
        "present": dq.not_null(table, ["k", "v", "d"]), "v present": dq.not_null(table, ["v"]),
    }
    assert found == {name: check.count() for name, check in alone.items()} | {"small": 2 + 3}
    assert {n for _, n in rows(dq.table_checks(table.limit(0), rules))} == {0}
    only_rows = {"small": dq.Rows((table["v"] > 2,)), "present": dq.NotNull(("k",))}
    assert dict(rows(dq.table_checks(table, only_rows))) == {"small": 2, "present": 1}


def test_history_checks_count_what_each_check_finds(spark, frame, rows):
    """Well-formed random versions with overlaps, gaps, missing and double current rows, against the single checks."""
    dim = spark.range(200).selectExpr(
        "concat('K', id % 11) AS ticker", "'x' AS gics_sector", "date_add(DATE '2020-01-01', CAST((id * 37) % 211 AS INT)) AS valid_from",
        "CASE WHEN id % 13 <> 0 THEN date_add(DATE '2020-01-01', CAST((id * 37) % 211 + id % 17 AS INT)) END AS valid_to",
        "id % 13 = 0 OR id % 50 = 0 AS is_current", "CAST(id AS INT) AS version_number", "IF(id % 9 = 0, 'other', 'initial') AS change_reason",
    )
    facts = spark.range(600).selectExpr("concat('K', id % 12) AS ticker", "date_add(DATE '2019-12-20', CAST((id * 7) % 260 AS INT)) AS trade_date")
    alone = (dq.overlaps(dim), dq.current_row_violations(dim), dq.gap_days(dim, facts), dq.integrity_violations(facts, dim), dq.scd2_shape(dim))
    counts = [check.count() for check in alone]
    assert dict(rows(dq.history_checks(dim, facts))) == dict(zip(dq.HISTORY_CHECKS, counts)) and min(counts) > 0
    assert {n for _, n in rows(dq.history_checks(dim.limit(0), facts.limit(0)))} == {0}


def test_fused_checks_read_each_table_once(spark, tmp_path):
    dim = spark.sql("SELECT 'A' AS ticker, DATE '2020-01-01' AS valid_from, CAST(NULL AS DATE) AS valid_to, TRUE AS is_current, 1 AS version_number, 'initial' AS change_reason")
    dim.write.parquet(str(tmp_path / "dim"))
    spark.sql("SELECT 'A' AS ticker, DATE '2020-01-01' AS trade_date").write.parquet(str(tmp_path / "facts"))
    dim, facts = spark.read.parquet(str(tmp_path / "dim")), spark.read.parquet(str(tmp_path / "facts"))
    rules = {"a": dq.Unique(("ticker",)), "b": dq.Unique(("ticker", "valid_from")), "c": dq.NotNull(("ticker",)), "d": dq.Accepted("change_reason", ("initial",))}

    def scans(df):
        return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")

    assert scans(dq.table_checks(dim, rules)) == 1 and scans(dq.history_checks(dim, facts)) == 2


def test_suite_oracle_leaves_no_tie_to_chance(frame, rows):
    """Two versions begin on one day, stored in either order: the one with the highest number is the last, as in the query."""
    import duckdb

    from queries.quality import _SUITE

    kept, ended = ("2020-01-01", None, True), ("2020-01-01", "2020-01-03", False)
    later = ("2020-02-01", None, False)
    versions = [(f"{name}{k}", *v, n, "initial", "x", "y") for k in range(40) for name, order in (("a", (1, 2)), ("b", (2, 1))) for n in order for v in [ended if n == 2 else kept]]
    versions += [(f"{name}{k}", *later, 3, "initial", "x", "y") for k in range(40) for name in "ab"]
    dim = frame("ticker:s valid_from:d valid_to:d is_current:b version_number:i change_reason:s gics_sector:s gics_sub_industry:s", versions)
    facts = frame("ticker:s trade_date:d", [(f"{name}{k}", "2020-01-10") for k in range(40) for name in "ab"])
    found = dict(rows(dq.history_checks(dim, facts)))
    connection = duckdb.connect()
    for name, df in {"dim_broken": dim, "prices": facts}.items():
        connection.register("given", df.toArrow())
        connection.execute(f"CREATE TABLE {name} AS FROM given")
    connection.execute("CREATE TABLE dim AS FROM dim_broken; CREATE TABLE unresolved AS FROM prices; CREATE TABLE universe AS SELECT ticker, gics_sector AS current_gics_sector FROM dim")
    wanted = {name: n for name, n, _ in connection.execute(_SUITE).fetchall()}
    assert found["no observed day in a gap"] == wanted["no observed day in a gap"] == 80
