"""Returns and temporal joins."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.operators import joins, windows
from queries.family import Family, r, rs
from queries.mapping import Inputs

FAMILY = Family()
_PRICE_SQL = f"SELECT ticker, trade_date, {r('close_price')}, volume FROM prices"
_RETURN_SQL = f"SELECT ticker, trade_date, {rs('close_price', 'prev_close', 'daily_return', 'log_return')}, volume FROM returns"
_FACT_SQL = f"""SELECT ticker, trade_date, {rs('daily_return', 'log_return')}, version_number,
       sector_at_trade_date, sector_today, is_misattributed FROM fact"""
FACT = ("ticker", "trade_date", "daily_return", "log_return", "version_number", "sector_at_trade_date", "sector_today", "is_misattributed")
IN_FORCE = "f.trade_date BETWEEN d.valid_from AND coalesce(d.valid_to, DATE '9999-12-31')"


@FAMILY.query(_PRICE_SQL, "prices")
def prices(i: Inputs) -> DataFrame:
    return i.prices()


@FAMILY.query(_RETURN_SQL, "returns")
def daily_returns(i: Inputs) -> DataFrame:
    return i.returns()


@FAMILY.query(_RETURN_SQL, "returns")
def daily_returns_sliced(i: Inputs) -> DataFrame:
    """The same, with each key's series cut into years."""
    return i.returns(slice_unit="year")


@FAMILY.query(
    f"""SELECT user_id AS ticker, event_id, {r('value')},
        {r('lag(value) OVER (PARTITION BY user_id ORDER BY (ts, event_id))', 'previous')} FROM events"""
)
def previous_event_sliced(i: Inputs) -> DataFrame:
    """Previous value per user at full time resolution, where a user's rows are not bounded."""
    events = i.table("events").select(
        F.col("user_id").alias("ticker"), "event_id", "ts", "value"
    )
    return windows.previous(events, "value", time="ts", tie="event_id", slice_unit="day").drop("ts")


@FAMILY.query(_FACT_SQL, "fact")
def fact_pit(i: Inputs) -> DataFrame:
    return joins.dual_label(i.returns(), i.dim()).select(*FACT)


@FAMILY.query(_FACT_SQL, "fact")
def fact_pit_sliced(i: Inputs) -> DataFrame:
    return joins.dual_label(i.returns(), i.dim(), strategy="sliced").select(*FACT)


@FAMILY.query(_FACT_SQL, "fact")
def fact_pit_asof(i: Inputs) -> DataFrame:
    return joins.dual_label(i.returns(), i.dim(), strategy="asof").select(*FACT)


@FAMILY.query(
    f"SELECT f.ticker, f.trade_date, d.gics_sector FROM prices f LEFT JOIN dim_gap d ON d.ticker = f.ticker AND {IN_FORCE}",
    "prices",
    "dim_gap",
)
def pit_join_left_gapped(i: Inputs) -> DataFrame:
    """Days inside a gap keep their row and get no label."""
    return joins.pit_join(i.prices().select("ticker", "trade_date"), i.gapped_dim(), how="left")


@FAMILY.query(
    f"""SELECT f.event_id, f.ticker, d.gics_sector
FROM (SELECT event_id, 0::BIGINT AS ticker, CAST(ts AS DATE) AS trade_date FROM events) f JOIN dim_crowd d ON d.ticker = f.ticker AND {IN_FORCE}""",
    "dim_crowd",
)
def pit_join_prefix(i: Inputs) -> DataFrame:
    """All events under one key, each with the last action of its day over all users."""
    events = i.table("events").select("event_id", F.lit(0).cast("bigint").alias("ticker"), "ts")
    return joins.pit_join(events, i.crowd_dim(), time="ts", strategy="prefix").drop("ts")


@FAMILY.query(
    f"SELECT f.ticker, f.trade_date, d.gics_sector FROM prices f JOIN dim_gap d ON d.ticker = f.ticker AND {IN_FORCE}",
    "prices",
    "dim_gap",
)
def pit_join_asof_gapped(i: Inputs) -> DataFrame:
    return joins.pit_join(i.prices().select("ticker", "trade_date"), i.gapped_dim(), strategy="asof")


@FAMILY.query(
    "SELECT f.ticker, f.trade_date, d.gics_sector FROM prices f JOIN dim d ON d.ticker = f.ticker AND d.is_current",
    "prices",
    "dim",
)
def naive_join(i: Inputs) -> DataFrame:
    return joins.naive_join(i.prices().select("ticker", "trade_date"), i.dim())


@FAMILY.query(
    f"SELECT f.event_id, f.ticker, f.trade_date, d.gics_sector FROM (SELECT event_id, user_id AS ticker, CAST(ts AS DATE) AS trade_date FROM events) f JOIN dim_user d ON d.ticker = f.ticker AND {IN_FORCE}",
    "dim_user",
)
def pit_join_user_events(i: Inputs) -> DataFrame:
    """Every event with the user's last action of that day."""
    events = i.table("events").select(
        "event_id", F.col("user_id").alias("ticker"), F.col("ts").cast("date").alias("trade_date")
    )
    return joins.pit_join(events, i.user_dim(), strategy="sliced", slice_unit="month")


_STAMPED = f"""
SELECT f.event_id, f.ticker, d.gics_sector
FROM (SELECT event_id, user_id AS ticker, CAST(ts AS DATE) AS trade_date FROM events) f
JOIN dim_user d ON d.ticker = f.ticker AND {IN_FORCE}"""


def _stamped(i: Inputs, **how) -> DataFrame:
    """Events as they come, with a timestamp; the label of the day is wanted."""
    events = i.table("events").select("event_id", F.col("user_id").alias("ticker"), "ts")
    return joins.pit_join(events, i.user_dim(), time="ts", **how).drop("ts")


@FAMILY.query(_STAMPED, "dim_user")
def pit_join_timestamp_range(i: Inputs) -> DataFrame:
    return _stamped(i)


@FAMILY.query(_STAMPED, "dim_user")
def pit_join_timestamp_sliced(i: Inputs) -> DataFrame:
    return _stamped(i, strategy="sliced", slice_unit="month")


@FAMILY.query(_STAMPED, "dim_user")
def pit_join_timestamp_asof(i: Inputs) -> DataFrame:
    return _stamped(i, strategy="asof", slice_unit="month")


@FAMILY.query(
    f"SELECT f.ticker, f.trade_date, d.gics_sector FROM prices f JOIN dim_gap d ON d.ticker = f.ticker AND {IN_FORCE}",
    "prices",
    "dim_gap",
)
def pit_join_asof_narrow_days(i: Inputs) -> DataFrame:
    """A calendar cut within two years only; facts before and after keep their labels."""
    facts = i.prices().select("ticker", "trade_date")
    return joins.pit_join(facts, i.gapped_dim(), strategy="asof", slice_unit="quarter", days=(date(1996, 5, 17), date(1998, 2, 3)))


@FAMILY.query(
    "SELECT gics_sector FROM dim WHERE ticker = 42 AND DATE '1998-06-15' BETWEEN valid_from AND coalesce(valid_to, DATE '9999-12-31')",
    "dim",
)
def pit_lookup(i: Inputs) -> DataFrame:
    return joins.lookup(i.dim(), 42, date(1998, 6, 15))


@FAMILY.query(
    """
SELECT q.ticker, q.as_of, d.gics_sector
FROM (SELECT o_orderkey, o_custkey AS ticker, CAST(o_orderdate AS DATE) + 45 AS as_of FROM orders) q
LEFT JOIN dim_gap d ON d.ticker = q.ticker AND q.as_of BETWEEN d.valid_from AND coalesce(d.valid_to, DATE '9999-12-31')""",
    "dim_gap",
)
def pit_lookup_batch(i: Inputs) -> DataFrame:
    """One request per order: the customer's label 45 days later."""
    requests = i.table("orders").select(
        F.col("o_custkey").alias("ticker"), F.date_add(F.col("o_orderdate").cast("date"), 45).alias("as_of")
    )
    return joins.lookup_many(i.gapped_dim(), requests)


@FAMILY.query(
    f"SELECT count(*) AS joined_rows FROM prices f JOIN dim d ON d.ticker = f.ticker AND {IN_FORCE}", "prices", "dim"
)
def range_join_count(i: Inputs) -> DataFrame:
    return joins.range_join_count(i.prices(), i.dim())


@FAMILY.query(
    f"""
SELECT ticker, trade_date, (SELECT count(*) FROM dim_broken d WHERE d.ticker = f.ticker AND {IN_FORCE}) AS matching_dimension_rows
FROM prices f""",
    "prices",
    "dim_broken",
)
def match_counts(i: Inputs) -> DataFrame:
    return joins.match_counts(i.prices(), i.broken_dim())
