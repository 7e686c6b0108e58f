"""Change events, the dimension and its walks, the forward tracker."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.model import SECTOR_RENAME
from chronoframe.operators import chains, comparison, joins, scd2, windows
from chronoframe.streaming import Tracker
from queries.family import Family
from queries.mapping import WINDOW, Inputs
from queries.storage import new_folder

FAMILY = Family()
DIM = "ticker, gics_sector, gics_sub_industry, valid_from, valid_to, is_current, version_number, change_reason"


@FAMILY.query("SELECT * FROM log", "log")
def change_log(i: Inputs) -> DataFrame:
    return i.change_log()


@FAMILY.query(
    "SELECT * FROM log_rl WHERE ticker IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)", "log_rl"
)
def staged_events(i: Inputs) -> DataFrame:
    solvent = i.table("customer").filter(F.col("c_acctbal") >= 0).select(F.col("c_custkey").alias("ticker"))
    return scd2.stage_events(i.change_log(relabel=True), solvent)


@FAMILY.query(
    "SELECT *, DATE '1900-01-01' AS valid_from, CAST(NULL AS DATE) AS valid_to, TRUE AS is_current, 1 AS version_number, 'initial' AS change_reason FROM opening",
    "opening",
)
def opening_state(i: Inputs) -> DataFrame:
    return scd2.opening_state(i.universe(), i.change_log())


@FAMILY.query(f"SELECT {DIM} FROM dim", "dim")
def dim_scd2(i: Inputs) -> DataFrame:
    return i.dim()


@FAMILY.query(f"SELECT {DIM} FROM dim_rl", "dim_rl")
def dim_scd2_relabelled(i: Inputs) -> DataFrame:
    return i.dim(relabel=True)


@FAMILY.query(f"SELECT {DIM} FROM dim_gap", "dim_gap")
def dim_scd2_stepwise(i: Inputs) -> DataFrame:
    """The three-step build, over changes that leave days uncovered."""
    analysable = i.universe()
    events = scd2.stage_events(i.gapped_log(), analysable)
    return scd2.replay(scd2.opening_state(analysable, events), events)


@FAMILY.query(f"SELECT {DIM} FROM dim_user", "dim_user")
def dim_scd2_users(i: Inputs) -> DataFrame:
    return i.user_dim()


@FAMILY.query(
    "SELECT change_reason, count(*) AS versions FROM dim_rl GROUP BY change_reason", "dim_rl"
)
def versions_by_reason(i: Inputs) -> DataFrame:
    return i.dim(relabel=True).groupBy("change_reason").agg(F.count(F.lit(1)).alias("versions"))


@FAMILY.query(
    "SELECT count(*) AS dimension_rows, count(*) FILTER (version_number > 1) AS later_versions, count(*) FILTER (is_current) AS current_rows FROM dim",
    "dim",
)
def dim_stats(i: Inputs) -> DataFrame:
    return scd2.dim_stats(i.dim())


@FAMILY.query("SELECT DISTINCT ON (gics_sector) gics_sector, valid_from AS sector_existed_from FROM dim_rl ORDER BY gics_sector, valid_from", "dim_rl")
def group_birth(i: Inputs) -> DataFrame:
    return scd2.group_birth(i.dim(relabel=True))


@FAMILY.query(
    "SELECT first_trading_day, count(*) FILTER (o.ticker IS NOT NULL) AS rows_closed, count(*) AS rows_opened FROM log l LEFT JOIN (SELECT o_custkey AS ticker FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON o.ticker = l.ticker GROUP BY 1 HAVING count(*) <> count(*) FILTER (o.ticker IS NOT NULL)",
    "log",
)
def replay_imbalance(i: Inputs) -> DataFrame:
    """Events replayed onto the opening rows of customers with a finished order only."""
    finished = i.table("orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("ticker"))
    return scd2.replay_imbalance(finished.distinct(), i.change_log())


@FAMILY.query(
    """
SELECT ticker, change_type, old_gics_sector, new_gics_sector, old_gics_sub_industry, new_gics_sub_industry,
       effective_after_close, first_trading_day, expected_old_sector
FROM (SELECT *, lag(new_gics_sector) OVER (PARTITION BY ticker ORDER BY first_trading_day) AS expected_old_sector
      FROM log WHERE new_gics_sector <> '3-MEDIUM')
WHERE expected_old_sector IS DISTINCT FROM old_gics_sector AND expected_old_sector IS NOT NULL""",
    "log",
)
def broken_continuity(i: Inputs) -> DataFrame:
    """Continuity of a log that lost its changes to 3-MEDIUM."""
    return scd2.broken_continuity(i.change_log().filter(F.col("new_gics_sector") != "3-MEDIUM"))


@FAMILY.query(
    """
, final AS (SELECT ticker, max(struct_pack(v := version_number, f := valid_from, s := gics_sector)) AS last FROM dim GROUP BY ticker)
SELECT ticker, security_name, current_gics_sector AS snapshot_sector, last.s AS dimension_current_sector,
       last.v AS versions_built, last.f AS current_version_from
FROM universe JOIN final USING (ticker)
EXCEPT SELECT ticker, security_name, current_gics_sector, current_gics_sector, last.v, last.f FROM universe JOIN final USING (ticker)""",
    "universe",
    "dim",
)
def dim_reconciliation(i: Inputs) -> DataFrame:
    """Healthy: empty."""
    return scd2.reconcile(i.dim(), i.universe())


@FAMILY.query(
    """
-- The state a truncated replay ends in is the last one begun by the day on which the log stops.
, final AS (SELECT ticker, max(struct_pack(f := valid_from, v := version_number, s := gics_sector)) AS last
            FROM dim_rl WHERE valid_from <= DATE '1998-12-31' GROUP BY ticker)
SELECT ticker, security_name, current_gics_sector AS snapshot_sector, last.s AS dimension_current_sector,
       last.v AS versions_built, last.f AS current_version_from
FROM universe JOIN final USING (ticker)
EXCEPT SELECT ticker, security_name, current_gics_sector, current_gics_sector, last.v, last.f FROM universe JOIN final USING (ticker)""",
    "universe",
    "dim_rl",
)
def dim_reconciliation_late_log(i: Inputs) -> DataFrame:
    """A log that stops in 1998, against today's snapshot: every later change is a finding."""
    early = i.change_log(relabel=True).filter(F.col("first_trading_day") <= F.lit(date(1998, 12, 31)))
    # Opening labels must still come from the full log.
    opening = scd2.opening_state(i.universe(relabel=True), i.change_log(relabel=True))
    return scd2.reconcile(scd2.replay(opening, early), i.universe())


@FAMILY.query(
    """
-- Days that a version claims within the window, against those of them on which its label existed.
, claims AS (
  SELECT d.*, existed_from, existed_to,
         unnest(range(greatest(valid_from, DATE '1996-01-01'),
                      least(ifnull(valid_to, DATE '2000-12-31'), DATE '2000-12-31') + 1, INTERVAL 1 DAY))::DATE AS day
  FROM dim_rl d NATURAL JOIN registry)
SELECT ticker, gics_sector, version_number, valid_from, valid_to,
       existed_from AS sector_existed_from, existed_to AS sector_existed_to,
       'claims sector ' || CASE WHEN min(day) < existed_from THEN 'before it existed' ELSE 'after it was retired' END AS violation
FROM claims GROUP BY ticker, gics_sector, version_number, valid_from, valid_to, existed_from, existed_to
HAVING count(*) > count(*) FILTER (day >= existed_from AND day <= ifnull(existed_to, day))""",
    "dim_rl",
    "registry",
)
def existence_violations(i: Inputs) -> DataFrame:
    return scd2.existence_violations(i.dim(relabel=True), i.registry(), WINDOW)


@FAMILY.query("SELECT ticker, max(version_number) + 1 AS next_version FROM dim GROUP BY ticker", "dim")
def next_version(i: Inputs) -> DataFrame:
    return windows.next_version(i.dim())


# --- chains -----------------------------------------------------------------
_POSITION = """
, placed AS (
  SELECT *, CAST(count(*) OVER sofar AS INTEGER) AS depth, lag(gics_sector) OVER history AS previous_label,
         ifnull(valid_from - lag(valid_to) OVER history <> 1, FALSE) AS parted
  FROM dim_gap WINDOW history AS (PARTITION BY ticker ORDER BY valid_from),
                      sofar AS (PARTITION BY ticker ORDER BY valid_from ROWS UNBOUNDED PRECEDING)),
counted AS (SELECT *, count_if(parted) OVER (PARTITION BY ticker ORDER BY valid_from) AS partings FROM placed)"""
_VERSION = "previous_label, valid_from, ifnull(strftime(valid_to, '%Y-%m-%d'), 'current') AS valid_to, change_reason"


@FAMILY.query(f"{_POSITION} SELECT ticker, depth, gics_sector, gics_sub_industry, {_VERSION} FROM counted WHERE partings = 0", "dim_gap")
def chain_calendar(i: Inputs) -> DataFrame:
    """A walk ends where the number of gaps so far leaves zero."""
    return chains.chain_calendar(i.gapped_dim())


@FAMILY.query(f"{_POSITION} SELECT ticker, depth, gics_sector, {_VERSION} FROM placed", "dim_gap")
def chain_successor(i: Inputs) -> DataFrame:
    return chains.chain_successor(i.gapped_dim())


@FAMILY.query(
    f"""{_POSITION}
SELECT ticker, depth, gics_sector, {_VERSION},
       string_agg(gics_sector, ' -> ') OVER (ORDER BY valid_from ROWS UNBOUNDED PRECEDING) AS sector_path
FROM placed WHERE ticker = 7""",
    "dim_gap",
)
def chain_of_one_key(i: Inputs) -> DataFrame:
    return chains.chain_successor(i.gapped_dim(), of=7)


@FAMILY.query(
    "SELECT count(*) AS versions, count(*) AS sector_keys FROM (SELECT DISTINCT ticker, version_number FROM dim)", "dim"
)
def surrogate_keys(i: Inputs) -> DataFrame:
    keyed = scd2.with_sector_key(i.dim())
    return keyed.agg(F.count(F.lit(1)).alias("versions"), F.count_distinct("sector_key").alias("sector_keys"))


@FAMILY.query(
    """
SELECT ticker, CAST(count(*) AS INTEGER) AS versions, string_agg(gics_sector, ' -> ' ORDER BY valid_from) AS sector_path
FROM dim GROUP BY ticker HAVING count(*) > 1""",
    "dim",
)
def all_chains(i: Inputs) -> DataFrame:
    return chains.all_chains(i.dim())


@FAMILY.query(
    """
SELECT ticker, CAST(count(*) AS BIGINT) AS rn, arg_max(gics_sector, valid_from) AS gics_sector, max(valid_from) AS valid_from
FROM dim GROUP BY ticker""",
    "dim",
)
def deepest_version(i: Inputs) -> DataFrame:
    numbered = windows.versions(i.dim()).select("ticker", "rn", "gics_sector", "valid_from")
    return windows.deepest_per_key(numbered, "ticker", "rn")


@FAMILY.query(
    """
SELECT ticker, first_trading_day, old_gics_sector, new_gics_sector
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY first_trading_day) AS nth FROM log) WHERE nth = 1""",
    "log",
)
def first_event(i: Inputs) -> DataFrame:
    log = i.change_log().select("ticker", "first_trading_day", "old_gics_sector", "new_gics_sector")
    return windows.first_per_key(log, "ticker", "first_trading_day")


# --- forward tracking -------------------------------------------------------
RUNS = (date(1998, 6, 30), date(1999, 12, 31), date(2001, 12, 31))


def _state_sql(day: date, where: str = "TRUE") -> str:
    return f"""SELECT * FROM (SELECT ticker, arg_max(label, day) AS current_gics_sector, arg_max(sub_label, day) AS current_sub_industry
        FROM states WHERE day <= DATE '{day}' GROUP BY ticker) WHERE {where}"""


def _step_sql(before: str, source: str, day: date) -> str:
    changed = "(s.current_gics_sector IS DISTINCT FROM t.current_gics_sector OR s.current_sub_industry IS DISTINCT FROM t.current_sub_industry)"
    return f"""
  SELECT t.ticker, t.current_gics_sector, t.current_sub_industry, t.valid_from,
         CASE WHEN t.valid_to IS NULL AND s.ticker IS NOT NULL AND {changed} THEN DATE '{day}' ELSE t.valid_to END AS valid_to
  FROM {before} t LEFT JOIN {source} s ON s.ticker = t.ticker
  UNION ALL
  SELECT s.ticker, s.current_gics_sector, s.current_sub_industry, DATE '{day}', NULL
  FROM {source} s LEFT JOIN (SELECT * FROM {before} WHERE valid_to IS NULL) t ON s.ticker = t.ticker
  WHERE t.ticker IS NULL OR {changed}"""


_TRACKED = f""",
s0 AS ({_state_sql(RUNS[0])}), s1 AS ({_state_sql(RUNS[1])}), s2 AS ({_state_sql(RUNS[2], "current_sub_industry <> 'P'")}),
t0 AS (SELECT *, DATE '{RUNS[0]}' AS valid_from, CAST(NULL AS DATE) AS valid_to FROM s0),
t1 AS ({_step_sql("t0", "s1", RUNS[1])}),
t2 AS ({_step_sql("t1", "s2", RUNS[2])})
SELECT * FROM t2"""


@FAMILY.query(_TRACKED, "states")
def snapshot_check(i: Inputs) -> DataFrame:
    """Three scheduled runs; before the last one some customers left the source."""
    tracked = scd2.snapshot_start(i.state_on(RUNS[0]), RUNS[0])
    tracked = scd2.snapshot_check(tracked, i.state_on(RUNS[1]), RUNS[1])
    remaining = i.state_on(RUNS[2]).filter(F.col("current_sub_industry") != "P")
    return scd2.snapshot_check(tracked, remaining, RUNS[2])


@FAMILY.query(_TRACKED, "states")
def tracked_by_stream(i: Inputs) -> DataFrame:
    """The same three runs, scheduled: states arrive as files, a stream takes what is new; a fourth run finds nothing."""
    folder = new_folder(i.spark, "tracked")
    tracker, arrivals = Tracker(i.spark, f"{folder}/dimension"), f"{folder}/arrivals"
    for number, day in enumerate((*RUNS, None)):
        if day is not None:
            states = i.state_on(day).filter(F.col("current_sub_industry") != "P") if day == RUNS[2] else i.state_on(day)
            states.withColumn("seen", F.lit(number)).write.mode("append").parquet(arrivals)
        source = i.spark.readStream.schema(i.spark.read.parquet(arrivals).schema).parquet(arrivals)
        tracker.run(source, f"{folder}/progress", order="seen", clock=lambda day=day: day).awaitTermination()
    return tracker.rows().select("ticker", "current_gics_sector", "current_sub_industry", "valid_from", "valid_to")


@FAMILY.query(
    """
SELECT ticker, trade_date FROM prices p
WHERE EXISTS (SELECT 1 FROM membership m WHERE m.ticker = p.ticker AND p.trade_date BETWEEN m.start_date AND m.end_date)""",
    "prices",
    "membership",
)
def members_on_date(i: Inputs) -> DataFrame:
    return joins.members_on(i.prices().select("ticker", "trade_date"), i.membership())


@FAMILY.query(
    "SELECT gics_sector, sector_existed_from, trading_days_in_window, trading_days_sector_absent FROM absent_rl", "absent_rl"
)
def absent_days(i: Inputs) -> DataFrame:
    observed = i.returns().filter(F.col("daily_return").isNotNull())
    return comparison.absent_days(i.dim(relabel=True), observed, WINDOW)


@FAMILY.query(
    "SELECT ticker, count(*) AS renames FROM dim_rl WHERE change_reason = 'sector_rename' GROUP BY ticker", "dim_rl"
)
def renamed_keys(i: Inputs) -> DataFrame:
    renames = i.dim(relabel=True).filter(F.col("change_reason") == SECTOR_RENAME)
    return renames.groupBy("ticker").agg(F.count(F.lit(1)).alias("renames"))
